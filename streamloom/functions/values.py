"""Names, word lists and patterns that must be just these for right results."""

# Sections of a caption and the node types they hold.
SECTIONS = {"OBJECTS": "entity", "PEOPLE": "entity", "ACTIONS": "action", "TEXT": "text_ocr", "SPATIAL": "spatial", "EVENT": "event"}

# Cues in a question that ask for memory.
MEMORY_CUES = {
    "just now": r"\bjust\s+now\b",
    "so far": r"\bso\s+far\b",
    "in total": r"\bin\s+total\b",
    "until now": r"\b(?:until|up\s+to|by)\s+now\b",
    "previously": r"\b(?:previously|earlier|already|moments?\s+ago|a\s+moment\s+ago)\b",
    "before/after": r"\b(?:before|after)\b",
    "summarize": r"\bsummar\w*",
    "how many times": r"\b(?:how\s+many\s+times|how\s+often)\b",
    "did": r"\bdid\b",
    "was/were": r"\b(?:was|were)\b",
    "had": r"\bhad\b",
    "perfect": r"\b(?:has|have|had)\s+(?:\w+\s+)?been\b",
    "happened": r"\bhappened\b",
}
WEAK_CUES = ("before/after",)

# Cues that ask for the present.
RECENT_CUES = {
    "right now": r"\bright\s+now\b",
    "currently": r"\b(?:currently|current)\b",
    "at this moment": r"\bat\s+(?:this|the)\s+moment\b",
    "is being": r"\b(?:is|are|am)\s+being\b",
    "about/going to": r"\b(?:about\s+to|going\s+to)\b",
    "present progressive": r"\b(?:is|are|am)\s+(?:he|she|it|they|we|you|i)?\s*\w+ing\b",
}

# Parts of prompts that are not the question.
SCAFFOLD = (
    r"you(?:'re|r)?\s+watching\s+a\s+video.*?(?=now,\s*answer|$)",
    r"you(?:'re|r)?\s+watching\s+a\s+tutorial\s+video.*?(?=the\s+following\s+is|$)",
    r"you(?:'re|r)?\s+responsible\s+of\s+answering.*?(?=\n|$)",
    r"you(?:'re|r)?\s+task\s+is\s+to.*?(?=\n|$)",
    r"now,\s*answer\s+the\s+following\s+question:\s*",
    r"answer\s+the\s+following\s+question:\s*",
    r"respond\s+only\s+with.*?$",
    r"answer\s+only\s+with.*?$",
    r"provide\s+your\s+answer\s+as.*?$",
    r"do\s+not\s+include\s+any\s+additional\s+text.*?$",
    r"decide\s+whether\s+existing\s+visual\s+content.*?$",
    r"one\s+complete\s+motion\s+counts\s+as\s+one\.?",
    r"the\s+person\s+performing\s+this\s+kind\s+of\s+action.*?$",
    r"the\s+following\s+question\s+are\s+relevant\s+to\s+the\s+latest\s+frames.*?$",
    r"^\s*options?\s*:.*$",
    r"^\s*question\s*:\s*",
)

# Phrases of questions that count, and of those that ask for the latest.
COUNT_PHRASES = ("how many times", "how often", "number of times", "count how many", "how many")
RECENCY_PHRASES = ("just now", "so far", "summariz", "primary focus")

# The sign that no node was found, and the words around counts in a context.
NO_MATCH_SIGNAL = "未找到匹配节点"
COUNT_TITLE = "[Counting Aggregate — observed action occurrences across captioned chunks]\n"
SEMANTIC_COUNT = (
    "[Counting Aggregate — semantic match (no exact verb match; using cosine over action embeddings)]\n",
    "]\n  Matching captions: ",
    "\n  Note: this is an estimate from semantic similarity; the actual number may be lower if some matches are false positives.",
)

# Words that point to an order in time.
TEMPORAL_WORDS = ("after", "before", "then", "next", "when", "order", "sequence", "first", "last", "earlier", "later", "previously", "follow", "subsequent", "happen", "did", "while", "during", "step")

# Words without content in questions that count.
COUNT_STOP_WORDS = (
    "they", "them", "their", "this", "that", "these", "those", "what", "when", "where", "which", "while", "until", "after",
    "before", "during", "from", "into", "with", "about", "have", "having", "had", "has", "many", "much", "more",
    "time", "times", "video", "scene", "scenes", "person", "people", "thing", "things", "happen", "happens",
    "different", "kind", "kinds", "total", "complete", "completes", "motion", "count", "counts", "answer", "answers",
    "question", "questions", "follow", "follows", "given", "perform", "performs", "show", "shows", "watch", "watches",
    "action", "actions", "event", "events", "does", "doing", "doer", "type", "types",
)

# Number words in options.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
}

# Tasks of the benchmark, by section.
TASKS = {"backward": ("EPM", "ASI", "HLD"), "realtime": ("OCR", "ACR", "ATR", "STU", "FPD", "OJR"), "forward": ("REC", "SSR", "CRR")}

# Thresholds and caps.
MAX_NODES = 300
LINK_THRESHOLD = 0.65
SIM_THRESHOLD = 0.55
TOP_K_MAX = 12
RECENT_EVENTS = 6

# Profiles as (model, recent frames) -> floor, strict floor, largest k, attach threshold.
OVO_PROFILES = {"qwen2_5_vl": (0.60, 0.60, 8), "*": (0.55, 0.70, 12)}
STREAM_PROFILES = {
    ("*", 0): (None, 0.55, 12, 0.65),
    ("qwen2_5_vl", 4): (0.25, 0.55, 12, 0.55),
    ("qwen2_5_vl", 8): (0.635, 0.66, 12, 0.65),
    ("qwen3_vl", 4): (0.25, 0.55, 16, 0.65),
    ("qwen3_vl", 8): (0.25, 0.55, 8, 0.65),
}

#: Prompt texts of our own; all can be replaced by the caller.
CHOICE_TEMPLATE = "Question: {question}\nOptions:\n{options}\nAnswer with one letter."
DELTA_TEMPLATE = "Question: {question}\nFrom {previous} to {cutoff}; counted before: {count}\n{options}\nAnswer with one letter."
ACTIVITY_TEMPLATE = '\n\nThis video is watched for complete instances of "{activity}". Name "{activity}" among the actions only where its decisive moment is seen, once for each instance; name anything before or after it differently.'
