"""Fixed values. They have to equal the published data contract for results to agree, so they are stated as is."""

# Tokens that mean "missing" in label and metadata fields.
MISSING_TOKENS = ["", "nan", "none", "null", "na"]

# Known misprints of the released sentences, applied in this order.
TYPO_BOOK = [
    ("emp11111ty", "empty"),
    ("film.1", "film."),
    ("–", "-"),
    ("’s", "'s"),
    ("�s", "'s"),
    ("`s", "'s"),
    ("Maria", "Marić"),
    ("1Universidad", "Universidad"),
    ("1902—19", "1902 - 19"),
    ("Wuerttemberg", "Württemberg"),
    ("long -time", "long-time"),
    ("Jose", "José"),
    ("Bucher", "Bôcher"),
    ("1839 ? May", "1839 - May"),
    ("G�n�ration", "Generation"),
    ("Bragança", "Bragana"),
    ("1837?October", "1837 - October"),
    ("nVera-Ellen", "Vera-Ellen"),
    ("write Ethics", "wrote Ethics"),
    ("Adams-Onis", "Adams-Onís"),
    ("(40 km?)", "(40 km²)"),
    ("(40 km˝)", "(40 km²)"),
    (" (IPA: /?g?nz?b?g/) ", " "),
    ('""Canes""', '"Canes"'),
]

# Reading tasks of the raw task names.
READING_TASKS = {"task1": "SR", "task2": "NR", "task3": "TSR"}

# Label ontologies.
SENTIMENTS = ["negative", "neutral", "positive"]
RELATIONS = [
    "AWARD", "EDUCATION", "EMPLOYER", "FOUNDER", "JOB_TITLE",
    "NATIONALITY", "POLITICAL_AFFILIATION", "VISITED", "WIFE",
]
INSTRUCTION_RELATIONS = RELATIONS + ["CONTROL"]
NO_RELATION = "NO-RELATION"

# Other spellings of the relation labels.
RELATION_ALIASES = {
    "awarding": "AWARD",
    "award": "AWARD",
    "education": "EDUCATION",
    "employment": "EMPLOYER",
    "employer": "EMPLOYER",
    "foundation": "FOUNDER",
    "founder": "FOUNDER",
    "job title": "JOB_TITLE",
    "job_title": "JOB_TITLE",
    "nationality": "NATIONALITY",
    "political affiliation": "POLITICAL_AFFILIATION",
    "political_affiliation": "POLITICAL_AFFILIATION",
    "visit": "VISITED",
    "visited": "VISITED",
    "marriage": "WIFE",
    "wife": "WIFE",
}

# Length strata: upper bound (words) and name; the last one is open.
LENGTH_STRATA = [(5, "0-5"), (10, "6-10"), (15, "11-15"), (20, "16-20"), (30, "21-30"), (None, "31+")]

# Task prompts in the two published modes.
TASK_PROMPTS = {
    "released": {"task1": "<NR>", "task2": "<NR>", "task3": "<TSR>"},
    "canonical": {"task1": "<SR>", "task2": "<NR>", "task3": "<TSR>"},
}

# Sentences of the prompt template.
PROMPT_OPENING = "System: Based on the following EEG signals, reconstruct the text."
PROMPT_CLOSING = "Target: "

# Columns holding the paraphrases of a sentence.
VARIANT_COLUMNS = [
    "lexical simplification (v0)", "lexical simplification (v1)",
    "semantic clarity (v0)", "semantic clarity (v1)",
    "syntax simplification (v0)", "syntax simplification (v1)",
    "naive rewritten", "naive simplified",
]

# Decision constants.
SUPERIORITY_MARGIN = 0.02
TASK_NONINFERIORITY_MARGIN = 0.01
SIGNAL_NONINFERIORITY_MARGIN = 0.005
SUPERIORITY_QUANTILE = 0.0125
CHANCE_QUANTILE = 0.025
TOP1_SLACK = 1e-9
STD_FLOOR = 1e-12

# Signal geometry: samples per second before and after resampling, padded shape.
SOURCE_RATE, TARGET_RATE = 500, 128
TARGET_SAMPLES, TARGET_CHANNELS = 1280, 128
MIN_SECONDS, MAX_SECONDS = 0.5, 10.0

# English stop words (function words) for content-word recall and keywords.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below "
    "between both but by can did do does doing down during each few for from further had has have having "
    "he her here hers herself him himself his how i if in into is it its itself just me more most my "
    "myself no nor not now of off on once only or other our ours ourselves out over own same she should "
    "so some such than that the their theirs them themselves then there these they this those through to "
    "too under until up very was we were what when where which while who whom why will with you your "
    "yours yourself yourselves "
    # what tokenising leaves of contractions
    "ain aren couldn d didn doesn don hadn hasn haven isn ll m ma mightn mustn needn o re s shan shouldn t "
    "ve wasn weren won wouldn y"
).split()
