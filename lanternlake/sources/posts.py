"""Posts for the queries: driver documents plus phrases.

The documents' prose is invented and meets no rule, so each post gets one of PHRASES by its number, in Spark and in the SQL
alike: positives of every group, both sides of thresholds, and negatives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PHRASES = [
    "",
    "Study in Germany! 100% visa guaranteed admission for students. Apply now, limited seats.",
    "No IELTS required: masters in Germany with top public universities, contact us.",
    "Study in Germany for free, no tuition fee, dream job and global career await. DM us!",
    "Congratulations to Rahul who secured admission and student visa for Germany, success story of our student.",
    "Germany student visa approval guarantee, confirmed admission, hurry up few seats left.",
    "Study abroad: Germany admission support and visa assistance from our consultancy, free consultation.",
    "Our university offers a bachelor program in computer science with scholarship for international students.",
    "Semester fee, health insurance and living costs apply; proof of funds and blocked account are needed.",
    "Public universities in Germany: tuition free study, bright future, turn your dreams into reality.",
    "Fashion and food giveaway, study in Germany football party.",
    "Campus life and holiday greetings from the student club.",
    "University of Applied Sciences admission for the master programme, DAAD scholarship.",
    "Low GPA accepted! IELTS not required, APS waived, no blocked account for Germany.",
    "See @Study.Expert and @study.expert. or www.example.com/a #Germany #StudyAbroad https://x.org/p.",
    "src3 15w Edited caption: apply today for the winter semester intake #intake",
    "Leading university, prestigious german universities, german public university, study in Germany.",
    "Life-changing opportunity, career opportunities, agency counselling, register now; MS in Germany.",
    "A master degree in engineering: M.Sc. and B.Sc courses, full-time, english-taught, tuition fee waiver.",
    "Last chance! Only 5 seats. Reach out today, link in bio, book a free consultation.",
    "\U0001f600\U0001f680 study ☀☀ now \U0001f1e9\U0001f1ea and \U0001f4da",
    "Work in Germany as skilled workers; start your career, job opportunities, move to Germany.",
    "47 likes and 1 comments on a normal day, view all 12 comments, see translation.",
    "Assured scholarship and sure-shot visa success, instant admission to Germany.",
    "No ıelts requıred for a master ın Germany, public unıversity admıssion guaranteed.",
    "Student success stories: she received offer letter and got admission at Berlin University.",
]
LABELS = ["none", "legitimate", "official", "Suspicious", "", "fake", "weird", "non-suspicious"]


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, post_id, account_name, caption_text, language, phrase, given_label."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    phrases = F.array(*map(F.lit, PHRASES))
    labels = F.array(*map(F.lit, LABELS))
    pick = lambda a, n: F.get(a, F.pmod(F.col("doc_id"), F.lit(n)).cast("int"))
    return docs.select(
        F.col("doc_id").alias("ord"),
        F.col("doc_id").cast("string").alias("post_id"),
        F.col("source").alias("account_name"),
        F.concat_ws(" ", F.coalesce("text", F.lit("")), pick(phrases, len(PHRASES))).alias("caption_text"),
        F.col("lang").alias("language"),
        pick(phrases, len(PHRASES)).alias("phrase"),
        pick(labels, len(LABELS)).alias("given_label"),
    )


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql(before: str = "") -> str:
    """WITH clause of the same posts for the SQL side; before: further common tables."""
    phrases = "[" + ", ".join(map(quote, PHRASES)) + "]"
    labels = "[" + ", ".join(map(quote, LABELS)) + "]"
    return f"""WITH posts AS (SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS post_id, source AS account_name,
  coalesce(text, '') || ' ' || {phrases}[1 + doc_id % {len(PHRASES)}] AS caption_text, lang AS language,
  {phrases}[1 + doc_id % {len(PHRASES)}] AS phrase, {labels}[1 + doc_id % {len(LABELS)}] AS given_label FROM documents){"," if before else ""} {before} """
