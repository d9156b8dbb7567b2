"""File sources and sinks: post JSON and CSV, annotation tasks, metrics, account registries; CSV, JSON and model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X

POST = "struct<post_id:string,post_url:string,platform:string,account_name:string,caption_text:string,hashtags:string,screenshot_url:string,posting_time:string,external_link:string,language:string,seed_label:string,account_category:string>"
ENVELOPES = ["data", "posts", "items", "records"]


def read_post_dir(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Posts of all JSON files of a folder: ord (file and position), source_file and the raw columns.

    A file is a list, or an object with a list under the first of ENVELOPES; malformed files and files without posts (three of
    four identifying fields in one of the first five records) are left out.  Each file is one value: crawler files are small.
    """
    whole = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(path)
    files = whole.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"), F.col("value").alias("j"))
    texts = "array<string>"  # records stay JSON text: a malformed file gives null
    lists = [F.from_json("j", texts), *[F.from_json(F.get_json_object("j", f"$.{e}"), texts) for e in ENVELOPES]]
    listed = files.withColumn("records", F.coalesce(*[F.when(F.trim(F.col("j")).startswith("["), lists[0]), *lists[1:]]))
    keys = ["post_id", "post_url", "account_name", "caption_text"]
    enough = lambda r: sum((F.get_json_object(r, f"$.{k}").isNotNull().cast("int") for k in keys), F.lit(0)) >= 3
    objects = listed.filter(F.exists(F.slice("records", 1, 5), enough)).select("source_file", F.posexplode("records").alias("pos", "r")).filter(F.trim("r").startswith("{"))
    rows = objects.select(F.struct("source_file", "pos").alias("ord"), "source_file", F.from_json("r", POST).alias("p"))
    return rows.select("ord", "source_file", "p.*")


def read_csv_text(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header, all columns as text, empty fields as empty texts."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, encoding=encoding).na.fill("")


def read_post_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv_text(spark, path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    own = F.nullif(F.trim(F.col("source_file")), F.lit("")) if "source_file" in rows.columns else F.lit(None)
    return rows.withColumn("source_file", F.coalesce(own, name)).withColumn("ord", F.struct(name.alias("source_file"), F.monotonically_increasing_id().alias("pos")))


def _tags(raw: Column) -> Column:
    return F.regexp_replace(F.coalesce(raw, F.lit("")), r'[\[\]"]', "")


def normalize(raw: DataFrame, missing_label: str = "none") -> DataFrame:
    """Raw posts to the 17 normalised columns: projected, filtered to English posts with text, first row of each post."""
    for c in fixed.RAW_COLUMNS:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(""))
    text = lambda c: X.strip(X.null_safe(F.col(c)))
    account = F.lower(F.ltrim(text("account_name"), F.lit("@")))
    rows = raw.withColumn("core", X.strip_ui(F.col("caption_text"))).withColumn("account", account)
    tags = X.hashtags(_tags(F.col("hashtags")), F.col("core"))
    out = rows.select(
        "ord",
        text("post_id").alias("post_id"),
        text("post_url").alias("post_url"),
        F.lower(F.coalesce(F.nullif(text("platform"), F.lit("")), F.lit("instagram"))).alias("platform"),
        F.col("account").alias("account_name"),
        "source_file",
        X.unify(F.col("caption_text")).alias("caption_text"),
        X.clean_text(F.col("core"), F.col("account")).alias("clean_text"),
        X.model_text(F.col("core"), F.array_join(tags, " "), F.col("external_link")).alias("model_text"),
        F.array_join(tags, "|").alias("hashtags"),
        F.array_join(X.mentions(F.col("core")), "|").alias("mentions"),
        X.url_count(F.col("core")).alias("url_count"),
        X.emoji_runs(F.col("core")).alias("emoji_count"),
        text("external_link").alias("external_link"),
        F.replace(text("screenshot_url"), F.lit("\\"), F.lit("/")).alias("screenshot_url"),
        X.iso_time(F.col("posting_time")).alias("posting_time"),
        F.lower(F.coalesce(F.nullif(text("language"), F.lit("")), F.lit("en"))).alias("language"),
        X.seed_label(F.col("seed_label"), F.col("source_file"), missing_label).alias("seed_label"),
    )
    good = out.filter((F.col("language") == "en") & (F.col("post_id") != "") & (F.col("clean_text") != "") & (F.col("model_text") != ""))
    from ..operators.split import keep_first

    return keep_first(good, "post_id", "ord").select(*fixed.NORMALIZED_COLUMNS)


_VALUE = "struct<start:int,end:int,text:string,labels:array<string>,choices:array<string>>"
_RESULT = f"array<struct<type:string,from_name:string,origin:string,value:{_VALUE}>>"
TASK = f"struct<data:struct<post_id:string,post_url:string,account_name:string,seed_label:string,text:string,clean_text:string,caption_text:string>,annotations:array<struct<was_cancelled:boolean,created_at:string,updated_at:string,result:{_RESULT}>>,predictions:array<struct<result:{_RESULT}>>>"


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation tasks (a list, or under 'tasks') to posts with valid spans and relation labels, from the newest annotation
    that isn't cancelled."""
    j = spark.read.option("wholetext", True).text(path)
    tasks = F.coalesce(F.from_json("value", f"array<{TASK}>"), F.from_json(F.get_json_object("value", "$.tasks"), f"array<{TASK}>"))
    rows = j.select(F.posexplode(tasks).alias("pos", "t")).select("pos", "t.*")
    live = F.filter("annotations", lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)))
    newest = F.get(F.sort_array(F.transform(live, lambda a, i: F.struct(F.coalesce(a["updated_at"], a["created_at"], F.lit("")).alias("at"), (-i).alias("i"), a["result"].alias("result"))), asc=False), F.lit(0))
    result = F.coalesce(newest["result"], F.get("predictions", F.lit(0))["result"])
    text = F.coalesce("data.text", "data.clean_text", "data.caption_text", F.lit(""))
    rows = rows.select("pos", F.coalesce("data.post_id", F.lit("")).alias("post_id"), F.coalesce("data.account_name", F.lit("")).alias("account_name"), F.coalesce("data.seed_label", F.lit("")).alias("seed_label"), text.alias("text"), result.alias("r"))
    ok = F.filter("r", lambda x: (x["type"] == "labels") & (x["value"]["start"] >= 0) & (x["value"]["start"] < x["value"]["end"]) & (x["value"]["end"] <= F.length("text")) & F.get(x["value"]["labels"], F.lit(0)).isin(fixed.NER_LABELS))
    spans = F.transform(ok, lambda x: F.struct(x["value"]["start"].alias("start"), x["value"]["end"].alias("end"), x["value"]["text"].alias("text"), F.get(x["value"]["labels"], F.lit(0)).alias("label"), x["origin"].alias("origin")))
    choices = F.flatten(F.transform(F.filter("r", lambda x: x["type"] == "choices"), lambda x: x["value"]["choices"]))
    return rows.select("pos", "post_id", "account_name", "seed_label", "text", X.match_text(F.col("text")).alias("caption_match_text"), X.fingerprint(F.col("text")).alias("caption_fingerprint"), spans.alias("spans"), F.array_sort(F.array_distinct(F.filter(choices, lambda c: c.isin(fixed.RE_LABELS)))).alias("relation_labels"))


def read_annotation_keys(spark: SparkSession, path: str, key: str = "post_id") -> DataFrame:
    """Distinct keys of annotated records: top level, under 'data', or the post's address."""
    j = spark.read.option("wholetext", True).text(path)
    lists = [F.from_json("value", "array<string>"), *[F.from_json(F.get_json_object("value", f"$.{e}"), "array<string>") for e in ("data", "tasks", "records")]]
    r = j.select(F.explode(F.coalesce(*lists)).alias("r"))
    found = F.coalesce(*[F.nullif(F.trim(F.get_json_object("r", p)), F.lit("")) for p in (f"$.{key}", f"$.data.{key}", "$.post_url", "$.data.post_url")])
    return r.select(found.alias(key)).filter(F.col(key).isNotNull()).distinct()


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Accounts of a registry file: a list, or lists under A, B and C; handles lower-case, without @."""
    account = "struct<handle:string,group:string,posts_crawled:int,status:string,max_posts_to_scan_per_account:string,max_saved_posts_per_account:string>"
    j = spark.read.option("wholetext", True).text(path)
    parts = [F.coalesce(F.from_json("value", f"array<{account}>"), F.array().cast(f"array<{account}>"))] + [F.coalesce(F.from_json(F.get_json_object("value", f"$.{k}"), f"array<{account}>"), F.array().cast(f"array<{account}>")) for k in "ABC"]
    rows = j.select(F.inline(F.concat(*parts)))
    return rows.filter("handle IS NOT NULL").withColumns({"handle": F.lower(F.ltrim(F.trim("handle"), F.lit("@"))), "status": F.coalesce("status", F.lit("active")), "posts_crawled": F.coalesce("posts_crawled", F.lit(0))})


def to_crawl(registry: DataFrame, limit: int = 120) -> DataFrame:
    """Active accounts that weren't crawled yet."""
    return registry.filter((F.col("status") == "active") & (F.col("posts_crawled") == 0)).limit(limit)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays as JSON text.  Parquet is the format between stages, CSV is for export."""
    flat = df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))})
    flat.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_report(one_row: DataFrame, path: str) -> None:
    one_row.coalesce(1).write.mode("overwrite").json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
