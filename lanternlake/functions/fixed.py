"""Word lists, patterns, tables and limits that results depend on."""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------------- fixed values: columns

RAW_COLUMNS = ["post_id", "post_url", "platform", "account_name", "caption_text", "hashtags", "screenshot_url", "posting_time", "external_link", "language", "seed_label"]
NORMALIZED_COLUMNS = ["post_id", "post_url", "platform", "account_name", "source_file", "caption_text", "clean_text", "model_text", "hashtags", "mentions", "url_count", "emoji_count", "external_link", "screenshot_url", "posting_time", "language", "seed_label"]
NER_LABELS = ["COST_CLAIM", "COST_DETAIL", "REQUIREMENT", "NEGATION_CUE", "PROGRAM_OR_INTAKE", "FIELD_OF_STUDY", "GENERIC_INSTITUTION", "SPECIFIC_EDU_ORG", "SERVICE_PROVIDER", "SUPPORT_SERVICE", "OUTCOME", "GUARANTEE_CUE", "VAGUE_BENEFIT", "PRESSURE_CUE", "TESTIMONIAL_ACTOR", "DESTINATION"]
RE_LABELS = ["OUTCOME_GUARANTEED", "REQUIREMENT_WAIVED", "TESTIMONIAL_SUCCESS_CLAIM", "PROGRAM_OR_OUTCOME_HAS_VERIFIABLE_ORG"]

# ---------------------------------------------------------------------------------------------------- fixed values: text normalisation

URL = r"(?:https?://\S+|www\.\S+)"
MENTION = r"@([A-Za-z0-9_.]+)"
HASHTAG = r"#([A-Za-z0-9_]+)"
EMOJI = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]+"
LIKES_PREFIX = r"^\s*\d[\d,\.]*\s+likes?\s*,\s*\d[\d,\.]*\s+comments?\s*-\s*[^:]{1,120}?\s+on\s+[^:]{1,80}:\s*"
AGE = r"(?:Edited\s*[•·\-]\s*)?(?:\d+\s*(?:s|sec|secs|second|seconds|m|min|mins|minute|minutes|h|hr|hrs|hour|hours|d|day|days|w|wk|wks|week|weeks|mo|mon|month|months|y|yr|yrs|year|years)\b|\d+w\b|\d+d\b|\d+h\b|\d+m\b|\d+s\b)\s*[•·\-:–—]?\s*"
ANY_ACCOUNT = r"[A-Za-z0-9_.]{2,40}"
ON_DATE = r"\s+on\s+[^:]{3,80}:\s*"
UI_NOISE = r"\b(?:view all \d+ comments?|view comments?|add a comment|see translation|translate|edited)\b"
TRAILING_TAGS = r"(?:\s*[#＃][A-Za-z0-9_]+[\.,;:!?]*)+\s*$"
LABEL_ALIASES = {
    "": "none", "null": "none", "nan": "none", "none": "none", "unknown": "none", "unlabeled": "none", "label_none": "none",
    "legit": "legitimate", "legitimate": "legitimate", "official": "legitimate", "normal": "legitimate", "safe": "legitimate",
    "non_suspicious": "legitimate", "non-suspicious": "legitimate", "non suspicious": "legitimate",
    "suspicious": "none", "sus": "none", "misleading": "none", "deceptive": "none", "fake": "none",
}
POSITIVE_LABELS = ["1", "true", "suspicious", "weak_suspicious", "misleading", "risky"]
NEGATIVE_LABELS = ["0", "false", "normal", "weak_normal", "legitimate", "legit", "official"]
DROPPED_LABELS = ["", "nan", "none", "unlabeled", "unknown", "uncertain", "skip", "out_scope", "out-of-scope", "review_required"]

# ---------------------------------------------------------------------------------------------------- fixed values: crawl filters

#: Replaced one after the other, in this order.
DEGREES_A = [("m.sc", "msc"), ("m.sc.", "msc"), ("m sc", "msc"), ("b.sc", "bsc"), ("b.sc.", "bsc"), ("b sc", "bsc"), ("m.a", "ma"), ("b.a", "ba"), ("m.eng", "meng"), ("b.eng", "beng"), ("ph.d", "phd"), ("ph.d.", "phd")]
DEGREES_B = [("m.sc", "msc"), ("m.sc.", "msc"), ("m sc", "msc"), ("b.sc", "bsc"), ("b.sc.", "bsc"), ("b sc", "bsc"), ("ph.d", "phd"), ("ph.d.", "phd"), ("m.a", "ma"), ("b.a", "ba"), ("m.eng", "meng"), ("b.eng", "beng")]

#: Trigger groups of suspicious posts: weight, patterns.
TRIGGERS = {
    "guaranteed_outcome": (3.5, [
        r"\b100\s*%\s*(visa|admission|success|approval)\b",
        r"\bguaranteed\s+(admission|visa|job|scholarship|seat|success)\b",
        r"\b(admission|visa|job|scholarship|seat)\s+guaranteed\b",
        r"\bconfirmed\s+admission\b",
        r"\bassured\s+(admission|visa|scholarship|job)\b",
        r"\bsure[-\s]?shot\s+visa\b",
        r"\bvisa\s+success\b",
        r"\bvisa\s+approval\s+guarantee\b",
        r"\binstant\s+admission\b",
    ]),
    "requirement_waived": (3.5, [
        r"\bno\s+ielts\b",
        r"\bwithout\s+ielts\b",
        r"\bielts\s+(not\s+required|waived|not\s+needed)\b",
        r"\bno\s+aps\b",
        r"\bwithout\s+aps\b",
        r"\baps\s+(not\s+required|waived|not\s+needed)\b",
        r"\bno\s+blocked\s+account\b",
        r"\bwithout\s+blocked\s+account\b",
        r"\bno\s+account\s+money\b",
        r"\bwithout\s+account\s+money\b",
        r"\b(any|low)\s+(gpa|cgpa)\s+(accepted|acceptable)\b",
        r"\bno\s+german\s+language\s+(required|needed)\b",
    ]),
    "free_or_no_tuition_claim": (2.0, [
        r"\bstudy\s+in\s+germany\s+for\s+free\b",
        r"\bstudy\s+for\s+free\s+in\s+germany\b",
        r"\bfree\s+education\s+in\s+germany\b",
        r"\bfree\s+tuition\b",
        r"\bno\s+tuition\s+fee\b",
        r"\btuition[-\s]?free\b",
        r"\blow\s+or\s+no\s+tuition\b",
        r"\blittle\s+to\s+no\s+tuition\b",
    ]),
    "testimonial_success": (2.0, [
        r"\bcongratulations?\b.{0,120}\b(admission|visa approval|student visa|offer letter|scholarship)\b",
        r"\bour\s+(student|client|candidate)\b.{0,120}\b(admission|visa approval|student visa|offer letter|scholarship)\b",
        r"\bsuccess\s+stor(y|ies)\b.{0,120}\b(admission|visa|scholarship|offer)\b",
        r"\bsecured\s+(admission|student visa|visa approval|scholarship|offer letter)\b",
        r"\breceived\s+(admission|student visa|visa approval|scholarship|offer letter)\b",
    ]),
    "generic_institution_claim": (1.2, [
        r"\btop\s+(public\s+)?universit(y|ies)\b",
        r"\bleading\s+(public\s+)?universit(y|ies)\b",
        r"\bprestigious\s+(german\s+)?universit(y|ies)\b",
        r"\bgerman\s+public\s+universit(y|ies)\b",
        r"\bgateway\s+to\s+german\s+public\s+universit(y|ies)\b",
    ]),
    "pressure_tactics": (1.5, [
        r"\blimited\s+(seats|slots)\b",
        r"\bfew\s+(seats|slots)\s+left\b",
        r"\blast\s+chance\b",
        r"\bhurry\s+up\b",
        r"\bdeadline\s+(today|soon|approaching)\b",
        r"\bapply\s+now\b",
        r"\bcontact\s+now\b",
        r"\bdm\s+us\b",
        r"\bregister\s+now\b",
    ]),
    "implicative_language": (0.7, [
        r"\bdream\s+(job|career|future)\b",
        r"\bglobal\s+career\b",
        r"\bbright\s+future\b",
        r"\blife[-\s]?changing\s+opportunit(y|ies)\b",
        r"\bmake\s+your\s+dreams?\s+come\s+true\b",
        r"\bturn\s+your\s+dreams?\s+into\s+reality\b",
        r"\bcareer\s+opportunit(y|ies)\b",
    ]),
    "service_context": (0.8, [
        r"\bconsultant(s)?\b",
        r"\bconsultancy\b",
        r"\bagency\b",
        r"\badmission\s+support\b",
        r"\bvisa\s+assistance\b",
        r"\bapplication\s+support\b",
        r"\bfree\s+consultation\b",
        r"\bexpert\s+guidance\b",
        r"\bcounselling\b",
        r"\bcounseling\b",
    ]),
}
HIGH_RISK = ["guaranteed_outcome", "requirement_waived"]
MIN_SCORE, MIN_GROUPS = 2.5, 2
SCOPE = [
    r"\bstudy\s+in\s+germany\b",
    r"\bmasters?\s+in\s+germany\b",
    r"\bms\s+in\s+germany\b",
    r"\bgermany\s+student\s+visa\b",
    r"\bgerman\s+public\s+universit(y|ies)\b",
    r"\bpublic\s+universit(y|ies)\s+in\s+germany\b",
    r"\bstudy\s+abroad\b.{0,80}\bgermany\b",
    r"\bgermany\b.{0,80}\b(admission|visa|ielts|aps|blocked account|tuition|university|masters?|bachelor|mba|msc)\b",
]
BAD_CONTENT = [
    r"\bgiveaway\b",
    r"\bfashion\b",
    r"\bmakeup\b",
    r"\bfood\b",
    r"\btravel\s+blog\b",
    r"\bfootball\b",
]
ENGLISH_WORDS = r"\b(the|and|for|with|study|germany|admission|visa|university|students?)\b"
ENGLISH_LENGTH, ENGLISH_SHARE = 40, 0.75
RESERVED_HANDLES = ["p", "reel", "reels", "explore", "accounts", "tags", "stories", "popular"]
HANDLE = r"^[a-z0-9._]{2,30}$"
#: Patterns of legitimate posts by category.
LEGITIMATE = {
    "degree_programs": [
        r"\bstudy in germany\b",
        r"\bstudy abroad\b",
        r"\bstudy with us\b",
        r"\bstudy at\b",
        r"\bjoin our\b",
        r"\bjoin us\b",
        r"\bapply now\b",
        r"\bapply today\b",
        r"\bapplications? open\b",
        r"\badmissions?\b",
        r"\benrol(l)?ment\b",
        r"\benrol(l)? now\b",
        r"\bprogram(me)?\b",
        r"\bdegree\b",
        r"\bcourse\b",
        r"\bcurriculum\b",
        r"\bstudy track\b",
        r"\bstudy option\b",
        r"\bacademic path\b",
        r"\bbachelor('?s)?\b",
        r"\bbachelors\b",
        r"\bbachelor program(me)?\b",
        r"\bbachelor degree\b",
        r"\bbsc\b",
        r"\bb\.sc\b",
        r"\bb\.sc\.\b",
        r"\bba\b",
        r"\bb\.a\b",
        r"\bbeng\b",
        r"\bb\.eng\b",
        r"\bllb\b",
        r"\bundergraduate\b",
        r"\bundergraduate program(me)?\b",
        r"\bmaster('?s)?\b",
        r"\bmasters\b",
        r"\bmaster degree\b",
        r"\bmaster program(me)?\b",
        r"\bmsc\b",
        r"\bm\.sc\b",
        r"\bm\.sc\.\b",
        r"\bma\b",
        r"\bm\.a\b",
        r"\bmeng\b",
        r"\bm\.eng\b",
        r"\bmba\b",
        r"\bemba\b",
        r"\bgraduate program(me)?\b",
        r"\bpostgraduate\b",
        r"\bphd\b",
        r"\bph\.d\b",
        r"\bdoctorate\b",
        r"\bdoctoral\b",
        r"\bdoctoral program(me)?\b",
        r"\bdoctoral research\b",
        r"\bcertificate\b",
        r"\bdiploma\b",
        r"\bexecutive education\b",
        r"\bon-campus\b",
        r"\bon campus\b",
        r"\bonline\b",
        r"\bhybrid learning\b",
        r"\bfull[- ]time\b",
        r"\bpart[- ]time\b",
        r"\benglish[- ]taught\b",
        r"\benglish speaking\b",
        r"\bcareer(s)?\b",
        r"\bglobal career(s)?\b",
        r"\bcareer opportunities\b",
        r"\bcareer path\b",
        r"\bskills?\b",
        r"\bpractical knowledge\b",
        r"\bindustry skills\b",
        r"\breal[- ]world\b",
        r"\bhands[- ]on\b",
        r"\btech industry\b",
        r"\bfuture career\b",
        r"\bjob market\b",
        r"\bbuild your future\b",
        r"\bprepare(s|d)? you for\b",
        r"\bcareer success\b",
        r"\binnovation\b",
        r"\bdigital future\b",
        r"\bnext generation\b",
        r"\binternational student(s)?\b",
        r"\bstudents from around the world\b",
    ],
    "scholarship": [
        r"\bscholarship(s)?\b",
        r"\bfunding\b",
        r"\bstipend\b",
        r"\bgrant\b",
        r"\bfinancial support\b",
        r"\bfinancial aid\b",
        r"\btuition\b",
        r"\btuition fee\b",
        r"\bfully funded\b",
        r"\bpartially funded\b",
        r"\bfee waiver\b",
    ],
    "timeline": [
        r"\bwinter semester\b",
        r"\bsummer semester\b",
        r"\bfall intake\b",
        r"\bspring intake\b",
        r"\bintake\b",
    ],
    "recruitment": [
        r"\bwork in germany\b",
        r"\bstudy and work\b",
        r"\bskilled workers?\b",
        r"\binternational talents?\b",
        r"\bjob opportunities\b",
        r"\bcareer opportunities\b",
        r"\bfuture in germany\b",
        r"\bmove to germany\b",
        r"\bstart your career\b",
        r"\bbuild your career\b",
    ],
}
EXCLUDED_CONTENT = [
    r"\bcampus life\b",
    r"\bparty\b",
    r"\bfood\b",
    r"\bsports day\b",
    r"\bholiday greetings?\b",
    r"\bresearch paper\b",
    r"\bfaculty award\b",
    r"\bvacation\b",
    r"\balumni reunion\b",
    r"\bgraduation ceremony\b",
    r"\bmerry christmas\b",
    r"\bhappy easter\b",
    r"\bnew year wishes\b",
    r"\bthrowback\b",
    r"\bbehind the scenes\b",
    r"\bstudent club\b",
    r"\bfootball\b",
    r"\bconcert\b",
]
KNOWN_ACCOUNTS = [
    r"daad_worldwide",
    r"studyingermany",
    r"makeitingermany",
    r"deutschland_de",
    r"goetheinstitut",
    r"uniassist_ev",
    r"expatrio",
    r"fintiba",
    r"tu.muenchen",
    r"rwthaachenuniversity",
    r"fu_berlin",
    r"unistuttgart",
    r"tu_dortmund",
]
BAD_HANDLES = [
    r"^explore$",
    r"^accounts$",
    r"^reel$",
    r"^reels$",
    r"^p$",
    r"^tv$",
    r"^stories$",
    r"^tags$",
    r"^directory$",
    r"^about$",
    r"^privacy$",
    r"^developer$",
    r"^instagram$",
]
QUERY_SEEDS = [
    r'"study in Germany" "admission" consultant',
    r'"study in Germany" "international students"',
    r'"study in Germany" "master" "consultancy"',
    r'"study in Germany" "student visa" consultant',
    r'"German public university" "masters" consultant',
    r'"Germany education consultant" "Instagram"',
    r'"study abroad Germany" "agency"',
    r'"Germany university admission" consultant',
    r'"Germany application support" "students"',
]
QUERY_SUFFIXES = [
    r"site:instagram.com",
    r"site:instagram.com/p",
]
HANDLE_IN_URL = r"instagram\.com/(?!p/|reel/|reels/|explore/|stories/|tv/|tags/)([A-Za-z0-9._]{2,30})(?:[/?#]|$)"
#: Search terms that are combined: scope, risk, service.
QUERY_SCOPES = ['"study in Germany"', '"Masters in Germany"', '"MS in Germany"', '"Germany public university"', '"Germany student visa"']
QUERY_RISKS = ['"no IELTS"', '"no APS"', '"no blocked account"', '"100% visa"', '"guaranteed admission"', '"confirmed admission"', '"visa success"', '"study in Germany for free"', '"no tuition fee"', '"limited seats"']
QUERY_SERVICES = ["consultant", "consultancy", "agency", '"education consultant"', '"visa assistance"']
MAX_QUERIES = 120

# ---------------------------------------------------------------------------------------------------- fixed values: splits

OFFICIAL_ACCOUNTS = [
    r"daad_worldwide",
    r"studyingermany",
    r"study.in.germany",
    r"study_in_germany",
    r"tu.muenchen",
    r"tumofficial",
    r"rwthaachenuniversity",
    r"fu_berlin",
    r"unistuttgart",
    r"tu_dortmund",
    r"uniassist_ev",
    r"makeitingermany",
    r"deutschland_de",
    r"goetheinstitut",
]
PRIVATE_ACCOUNTS = [
    r"iu.international",
    r"gisma.university",
    r"gisma_university",
    r"constructor_university",
    r"srh_university",
    r"srh_university_international",
    r"berlinsbi",
    r"eu_business_school",
    r"esmtberlin",
]
OFFICIAL_PARTS = ["daad", "uniassist", "goethe", "makeitingermany", "deutschland"]
#: Quotas: manual normal, manual suspicious, official, private.
QUOTAS = (50, 100, 20, 30)

# ---------------------------------------------------------------------------------------------------- fixed values: weak labelling

PATTERNS = {
    "COST_CLAIM": r"\b(study(?:ing)?\s+(?:in\s+germany\s+)?for\s+free|free\s+tuition|tuition[-\s]?free|no\s+tuition\s+fee|no\s+tuition|without\s+tuition\s+fee|free\s+education|low[-\s]?cost\s+education|low\s+tuition\s+fee)\b",
    "COST_DETAIL": r"\b(semester\s+(?:fee|fees|contribution)|living\s+(?:cost|costs|expenses)|cost\s+of\s+living|rent|accommodation\s+(?:cost|costs|fee|fees)|health\s+insurance|application\s+fee|administrative\s+fee|monthly\s+expenses?|tuition\s+fees?)\b",
    "REQUIREMENT": r"\b(ielts|aps|gpa|blocked\s+account|account\s+money|proof\s+of\s+funds|financial\s+proof|bank\s+statement|documents?|academic\s+transcripts?|sop|lor|cv|resume|passport|bachelor(?:'s)?\s+degree|degree\s+certificate|english\s+proficiency|german\s+language|german\s+(?:a1|a2|b1|b2|c1|c2)|language\s+certificate|visa\s+(?:requirements?|interview)|moi|medium\s+of\s+instruction|toefl|pte|duolingo|\bgre\b|\bgmat\b)\b",
    "NEGATION_CUE": r"\b(no|without|not\s+required|not\s+mandatory|not\s+needed|not\s+necessary|waived|exempted|no\s+need|isn'?t\s+required|are\s+not\s+required)\b",
    "PROGRAM_OR_INTAKE": r"\b(bachelor|master|m\.?\s?(?:sc|a)\.?|mba|ph\.?d\.?|mbbs|diploma|degree|course|programme|program|study\s+program|foundation\s+course|summer\s+\d{4}\s+intake|winter\s+\d{4}\s+intake|summer\s+intake|winter\s+intake|march\s+'?\d{2}\s+intake|\d{4}\s+intake)\b",
    "FIELD_OF_STUDY": r"\b(computer\s+science|data\s+science|artificial\s+intelligence|\bAI\b|\bIT\b|engineering|nursing|hospitality|business|management|cyber\s*security|chemical\s+and\s+energy\s+engineering|medicine|healthcare|robotics|automotive|mechanical|electrical|civil\s+engineering|finance|logistics|public\s+health)\b",
    "GENERIC_INSTITUTION": r"\b(top\s+(?:public\s+)?universit(?:y|ies)|public\s+universit(?:y|ies)|private\s+universit(?:y|ies)|german\s+universit(?:y|ies)|universit(?:y|ies)\s+in\s+germany|university\s+in\s+germany|leading\s+universit(?:y|ies)|prestigious\s+(?:german\s+)?universit(?:y|ies)|selected\s+institutions?|higher\s+education\s+institutions?|colleges?|public\s+institutions?)\b",
    "SUPPORT_SERVICE": r"\b(admission\s+support|visa\s+assistance|application\s+support|application\s+assistance|counselling|counseling|consultation|guidance|documentation|document\s+support|complete\s+assistance|assistance|coaching|guide\s+you\s+through|end[-\s]?to[-\s]?end\s+support|profile\s+evaluation)\b",
    "OUTCOME": r"\b(admission|admissions|admit|visa\s+approval|visa\s+success|student\s+visa|study\s+visa|scholarship|job\s+offer|employment\s+contract|placement|seat|spot|offer\s+letter|acceptance\s+letter|admission\s+letter|enrollment|enrolment)\b",
    "GUARANTEE_CUE": r"\b(guaranteed|guarantee|assured|confirmed|sure[-\s]?shot|100\s*%\s+(?:visa|admission|success|placement|scholarship|guarantee))\b",
    "VAGUE_BENEFIT": r"\b(dream\s+job|dream\s+career|job\s+opportunit(?:y|ies)|career\s+opportunit(?:y|ies)|global\s+(?:career|opportunit(?:y|ies))|bright\s+future|secure\s+your\s+future|life[-\s]?changing|world[-\s]?class\s+education|incredible\s+opportunities|future[-\s]?ready|academic\s+excellence|successful\s+academic\s+journey|rewarding\s+journey|transformative\s+journey|future\s+filled\s+with\s+possibilities|make\s+your\s+dreams\s+come\s+true|turn\s+your\s+dreams\s+into\s+reality|unlock\s+your\s+future|international\s+career|global\s+success)\b",
    "TESTIMONIAL_ACTOR": r"\b(congratulations(?:\s+to)?\s+[A-Z][A-Za-z]+|big\s+congratulations\s+(?:to\s+)?[A-Z][A-Za-z]+|our\s+student(?:s)?|our\s+client(?:s)?|successful\s+applicant|candidate|applicant|student\s+success\s+stor(?:y|ies))\b",
    "DESTINATION": r"\b(germany|deutschland|europe|berlin|munich|hamburg|magdeburg|stuttgart)\b",
    "PRESSURE_STRONG": r"\b(limited\s+(?:seats|slots|places)|few\s+(?:seats|slots|places)\s+left|last\s+chance|hurry\s+up|deadline\s+today|today\s+only|don'?t\s+miss|closing\s+soon|final\s+call|only\s+\d+\s+(?:seats|slots|places))\b",
    "PRESSURE_MEDIUM": r"\b(apply\s+now|book\s+now|register\s+now|contact\s+now|enroll\s+now|enrol\s+now|start\s+today|reach\s+out\s+today|schedule\s+(?:a\s+)?(?:free\s+)?consultation|book\s+(?:a\s+)?(?:free\s+)?consultation)\b",
    "PRESSURE_WEAK": r'\b(dm\s+us|dm\s+now|contact\s+us|link\s+in\s+bio|reach\s+out|call\s+us|message\s+us|inbox\s+us|comment\s+\"?germany\"?)\b',
    "STUDY_FREE": r"\b(study(?:ing)?\s+(?:in\s+germany\s+)?for\s+free|free\s+study\s+in\s+germany|study\s+free\s+in\s+germany)\b",
    "NO_TUITION": r"\b(no\s+tuition\s+fee|no\s+tuition|free\s+tuition|tuition[-\s]?free|without\s+tuition\s+fee)\b",
    "SEMESTER_FEE": r"\b(semester\s+(?:fee|fees|contribution))\b",
    "LIVING_COST": r"\b(living\s+(?:cost|costs|expenses)|cost\s+of\s+living|monthly\s+expenses?|rent|accommodation\s+(?:cost|costs|fee|fees)|health\s+insurance)\b",
    "BLOCKED_ACCOUNT": r"\b(blocked\s+account|account\s+money)\b",
    "PROOF_OF_FUNDS": r"\b(proof\s+of\s+funds|financial\s+proof|bank\s+statement)\b",
    "PUBLIC_PRIVATE_QUALIFIER": r"\b(public\s+universit(?:y|ies)|private\s+universit(?:y|ies)|state\s+universit(?:y|ies)|public\s+institutions?|private\s+institutions?)\b",
    "MATERIAL_CAVEAT": r"\b(semester\s+(?:fee|fees|contribution)|living\s+(?:cost|costs|expenses)|cost\s+of\s+living|rent|health\s+insurance|blocked\s+account|account\s+money|proof\s+of\s+funds|financial\s+proof|bank\s+statement|public\s+universit(?:y|ies)|private\s+universit(?:y|ies)|public\s+institutions?|private\s+institutions?)\b",
    "FUTURE_PROMISE": r"\b(unlock\s+your\s+future|start\s+your\s+journey|transform\s+your\s+career|future\s+filled\s+with\s+possibilities|secure\s+your\s+future)\b",
    "DREAM_JOB": r"\b(dream\s+job|dream\s+career|dream\s+university|dream\s+destination)\b",
    "GLOBAL_CAREER": r"\b(global\s+career|international\s+career|global\s+opportunit(?:y|ies)|career\s+opportunit(?:y|ies))\b",
    "LIFE_CHANGING": r"\b(life[-\s]?changing|transformative\s+journey|turn\s+your\s+dreams\s+into\s+reality|make\s+your\s+dreams\s+come\s+true)\b",
    "BRIGHT_FUTURE": r"\b(bright\s+future|successful\s+future|future[-\s]?ready|future\s+filled\s+with\s+possibilities)\b",
    "VAGUE_SUCCESS_PHRASE": r"\b(success\s+stor(?:y|ies)|successful\s+journey|achievement|milestone|academic\s+excellence)\b",
}
NAMED_ORGANISATION = r"\b(DAAD|TUM|TUHH|IU\s+International\s+University|SRH\s+University|BSBI|Uni[-\s]?Assist|University\s+of\s+[A-Z][A-Za-z\-]+(?:\s+[A-Z][A-Za-z\-]+){0,5}|[A-Z][A-Za-z\-]+(?:\s+[A-Z][A-Za-z\-]+){0,6}\s+(?:University|Universit(?:y|ät)|Institute|Hochschule|School))\b"
PROGRAM_OR_OUTCOME = r"\b(admission|admissions|admit|scholarship|master|bachelor|m\.?sc|mba|ph\.?d|course|programme|program|degree|visa\s+approval|student\s+visa)\b"
REQUIREMENT_WAIVED = r"\b(?:no|without|not\s+required|not\s+mandatory|not\s+needed|not\s+necessary|waived|exempted|no\s+need)\b.{0,60}\b(?:ielts|aps|blocked\s+account|account\s+money|proof\s+of\s+funds|financial\s+proof|german\s+language|gpa|documents?|toefl|pte|duolingo|moi|medium\s+of\s+instruction)\b|\b(?:ielts|aps|blocked\s+account|account\s+money|proof\s+of\s+funds|financial\s+proof|german\s+language|gpa|documents?|toefl|pte|duolingo|moi|medium\s+of\s+instruction)\b.{0,60}\b(?:not\s+required|not\s+mandatory|not\s+needed|not\s+necessary|waived|exempted)\b|\b(?:low\s+gpa|less\s+than\s+60\s*%|below\s+60\s*%|backlogs?)\b.{0,60}\b(?:accepted|eligible|allowed)\b"
OUTCOME_GUARANTEED = r"\b(?:guaranteed|guarantee|assured|confirmed|sure[-\s]?shot)\b.{0,60}\b(?:admission|admissions|visa\s+approval|visa\s+success|student\s+visa|study\s+visa|scholarship|job|placement|seat|spot|offer\s+letter|acceptance\s+letter)\b|\b(?:admission|admissions|visa\s+approval|visa\s+success|student\s+visa|study\s+visa|scholarship|job|placement|seat|spot|offer\s+letter|acceptance\s+letter)\b.{0,60}\b(?:guaranteed|guarantee|assured|confirmed|sure[-\s]?shot)\b|\b100\s*%\b.{0,50}\b(?:visa|admission|success|placement|scholarship|guarantee)\b|\b(?:visa|admission|success|placement|scholarship)\b.{0,50}\b100\s*%\b"
TESTIMONIAL_SUCCESS = r"\b(?:congratulations(?:\s+to)?|big\s+congratulations(?:\s+to)?|our\s+student(?:s)?|our\s+client(?:s)?|student\s+success\s+stor(?:y|ies))\b.{0,140}\b(?:secured|securing|received|receiving|got|achieved|obtained|has\s+secured|have\s+secured|was\s+admitted|were\s+admitted)\b.{0,100}\b(?:admission|admissions|visa\s+approval|student\s+visa|study\s+visa|scholarship|admit|offer\s+letter|acceptance\s+letter)\b|\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3}\b.{0,100}\b(?:secured|received|got|achieved|obtained)\b.{0,100}\b(?:admission|visa\s+approval|student\s+visa|study\s+visa|scholarship|admit|offer\s+letter|acceptance\s+letter)\b"
ORGANISATION_WINDOW = 120
#: Scored rules: name, what it is tested against in gold labels, the labels, default precision.
RULES = [
    ("LEX_COST_CLAIM", "ner", ["COST_CLAIM"], 0.80),
    ("LEX_COST_DETAIL", "ner", ["COST_DETAIL"], 0.80),
    ("LEX_REQUIREMENT", "ner", ["REQUIREMENT"], 0.75),
    ("LEX_NEGATION_CUE", "ner", ["NEGATION_CUE"], 0.90),
    ("LEX_PROGRAM_OR_INTAKE", "ner", ["PROGRAM_OR_INTAKE"], 0.75),
    ("LEX_FIELD_OF_STUDY", "ner", ["FIELD_OF_STUDY"], 0.70),
    ("LEX_GENERIC_INSTITUTION", "ner", ["GENERIC_INSTITUTION"], 0.75),
    ("LEX_SUPPORT_SERVICE", "ner", ["SUPPORT_SERVICE"], 0.70),
    ("LEX_OUTCOME", "ner", ["OUTCOME"], 0.75),
    ("LEX_GUARANTEE_CUE", "ner", ["GUARANTEE_CUE"], 0.90),
    ("LEX_VAGUE_BENEFIT", "ner", ["VAGUE_BENEFIT"], 0.65),
    ("LEX_PRESSURE_CUE", "ner", ["PRESSURE_CUE"], 0.80),
    ("LEX_TESTIMONIAL_ACTOR", "ner", ["TESTIMONIAL_ACTOR"], 0.75),
    ("LEX_DESTINATION", "ner", ["DESTINATION"], 0.90),
    ("LEX_STUDY_FREE", "ner", ["COST_CLAIM"], 0.85),
    ("LEX_NO_TUITION", "ner", ["COST_CLAIM"], 0.90),
    ("RULE_SEMESTER_FEE", "ner", ["COST_DETAIL"], 0.90),
    ("RULE_LIVING_COST", "ner", ["COST_DETAIL"], 0.85),
    ("RULE_BLOCKED_ACCOUNT", "ner", ["REQUIREMENT"], 0.90),
    ("RULE_PROOF_OF_FUNDS", "ner", ["REQUIREMENT"], 0.90),
    ("RULE_PUBLIC_PRIVATE_QUALIFIER", "any_ner", ["GENERIC_INSTITUTION", "COST_DETAIL"], 0.85),
    ("RULE_DIRECT_OUTCOME_GUARANTEE", "relation", ["OUTCOME_GUARANTEED"], 0.90),
    ("RULE_FUTURE_PROMISE", "ner", ["VAGUE_BENEFIT"], 0.60),
    ("RULE_DREAM_JOB", "ner", ["VAGUE_BENEFIT"], 0.65),
    ("RULE_GLOBAL_CAREER", "ner", ["VAGUE_BENEFIT"], 0.65),
    ("RULE_LIFE_CHANGING", "ner", ["VAGUE_BENEFIT"], 0.65),
    ("RULE_BRIGHT_FUTURE", "ner", ["VAGUE_BENEFIT"], 0.65),
    ("RULE_REQUIREMENT_WAIVED", "relation", ["REQUIREMENT_WAIVED"], 0.90),
    ("RULE_OUTCOME_GUARANTEED", "relation", ["OUTCOME_GUARANTEED"], 0.90),
    ("RULE_TESTIMONIAL_SUCCESS", "relation", ["TESTIMONIAL_SUCCESS_CLAIM"], 0.80),
    ("RULE_ORG_LINK", "relation", ["PROGRAM_OR_OUTCOME_HAS_VERIFIABLE_ORG"], 0.70),
    ("RULE_MATERIAL_CAVEAT", "any_ner", ["COST_DETAIL", "REQUIREMENT", "GENERIC_INSTITUTION"], 0.80),
    ("RULE_VAGUE_SUCCESS_PHRASE", "ner", ["VAGUE_BENEFIT"], 0.60),
    ("RULE_PRESSURE_STRONG", "ner", ["PRESSURE_CUE"], 0.90),
    ("RULE_PRESSURE_MEDIUM", "ner", ["PRESSURE_CUE"], 0.80),
    ("RULE_PRESSURE_WEAK", "ner", ["PRESSURE_CUE"], 0.65),
]
SOFT_ACTIVE, NORMAL_BELOW, SUSPICIOUS_FROM = 0.35, 0.40, 0.70
PRESSURE = {"STRONG": 1.00, "MEDIUM": 0.75, "WEAK": 0.45}
#: Deception types in order of declaration, and their tiers.
TYPES = ["OMISSION", "IMPLICATIVE_LANGUAGE", "LACK_OF_TRANSPARENCY", "GUARANTEED_OUTCOME", "PRESSURE_TACTICS", "MISLEADING_TESTIMONIAL", "ELIGIBILITY_MISREPRESENTATION"]
CRITICAL_TYPES = ["GUARANTEED_OUTCOME", "ELIGIBILITY_MISREPRESENTATION"]
PREVIEW = 350

# ---------------------------------------------------------------------------------------------------- fixed values: modelling

VOTE_WORDS = ["manual", "prediction-changed", "prediction"]
TFIDF = {"min_df": 2, "max_df": 0.95, "max_terms": 30000}
THRESHOLD_GRID = (0.05, 0.95, 91)
MIN_PRECISION = 0.60
CONTENT_GROUPS = ["presence_admission_program", "presence_international_recruitment_career", "presence_scholarship_funding", "presence_germany_destination", "presence_requirements_process", "presence_webinar_open_day_event"]
