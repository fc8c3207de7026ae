"""Word lists, labels, thresholds and messages.

Fixed values: results depend on them letter by letter. Every operator takes its list as a
parameter, and these are the defaults.
"""

CONTRACTIONS = (
    "don't can't won't i'm you're they're it's we're he's she's that's there's who's what's where's how's "
    "isn't aren't wasn't weren't hasn't haven't hadn't doesn't didn't couldn't wouldn't shouldn't "
    "i've you've we've they've i'll you'll he'll she'll we'll they'll it'll i'd you'd he'd she'd we'd they'd "
    "let's ain't mustn't shan't needn't mightn't"
).split()
LATIN_ABBREVIATIONS = [
    r"\be\.g\.",
    r"\bi\.e\.",
    r"\bviz\.",
    r"\bcf\.",
    r"\bet\s+al\.",
    r"\betc\.",
    r"\bibid\.",
    r"\bsic\b",
    r"\bper\s+se\b",
    r"\bad\s+hoc\b",
    r"\bde\s+facto\b",
    r"\binter\s+alia\b",
]
NOMINAL_SUFFIXES = "tion sion ment ness ity ance ence".split()
HEDGE_PHRASES = ["sort of", "kind of", "a bit", "tend to", "in some cases", "to some extent", "more or less"]
HEDGE_WORDS = (
    "perhaps maybe possibly somewhat rather quite fairly slightly apparently seemingly arguably presumably "
    "supposedly generally typically usually often sometimes might could may seem appear"
).split()
BRIDGING_PRONOUNS = "he she it they his her its their him them this that these those".split()
DISCOURSE_MARKERS = (
    "however therefore furthermore moreover additionally consequently nevertheless nonetheless meanwhile "
    "subsequently accordingly thus hence also besides instead otherwise similarly likewise although whereas "
    "while because since"
).split()
CONTENT_POS = ["NOUN", "VERB", "ADJ", "ADV", "PROPN"]
FORMAL_POS = ["NOUN", "ADJ", "ADP", "DET"]
INFORMAL_POS = ["PRON", "VERB", "ADV", "INTJ"]
PASSIVE_DEPS = ["nsubjpass", "auxpass"]
PERSONAL_PRONOUNS = "i me my mine myself you your yours yourself we us our ours ourselves".split()
INCLUSIVE_PRONOUNS = "we us our ours ourselves".split()
FILLERS = "basically literally actually honestly obviously clearly simply just really very quite pretty rather somewhat".split() + ["kind of", "sort of"]
MODALS = "can could may might must shall should will would ought".split()
IMPERATIVES = "do don't please make ensure check use add remove update create run set get note remember consider avoid keep".split()
TITLE_EXEMPT = "a an and as at but by for if in nor of on or so the to up yet".split()

#: Characters stripped around a word, and around the first word of a sentence.
WORD_STRIP = ".,;:!?\"'()[]"
FIRST_STRIP = ".,;:!?()[]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

CONTRACTION_PATTERN = (
    r"\b(?:can't|won't|don't|isn't|aren't|wasn't|weren't|hasn't|haven't|hadn't|doesn't|didn't|couldn't|shouldn't|wouldn't|mustn't"
    r"|it's|he's|she's|that's|there's|here's|what's|who's|I'm|you're|we're|they're|I've|you've|we've|they've"
    r"|I'll|you'll|he'll|she'll|we'll|they'll|I'd|you'd|he'd|she'd|we'd|they'd)\b"
)
FORMAL_PATTERN = (
    r"\b(?:e\.g\.|i\.e\.|viz\.|cf\.|et al\.|ibid\.|furthermore|moreover|notwithstanding|henceforth|aforementioned|hereinafter"
    r"|pursuant|whereby|utilise|utilize|facilitate|implement|commence|subsequently|consequently|accordingly)\b"
)

DIMENSIONS = ["readability", "naturalness", "vocabulary", "semantic_preservation", "tone_compliance"]
DEFAULT_WEIGHTS = dict(zip(DIMENSIONS, (0.25, 0.30, 0.20, 0.15, 0.10)))
FOCUS_PRIMARY, FOCUS_OTHER = 0.70, 0.075
FOCUS_MODES = {"readability": "readability", "naturalness": "naturalness", "persona_compliance": "tone_compliance"}
READABILITY_TARGETS = {
    "slack-casual": (7.0, 2.0),
    "jira-ticket": (9.0, 2.0),
    "pr-review": (12.0, 3.0),
    "confluence-docs": (11.0, 2.0),
    "technical-docs": (14.0, 3.0),
    "email-professional": (10.0, 2.5),
    "blog-post": (8.0, 3.0),
    "executive-summary": (12.0, 2.0),
}
DEFAULT_TARGET = (10.0, 4.0)
TONE_DIMENSIONS = ["formality", "confidence", "warmth", "directness", "energy", "verbosity"]

HINTS = {
    "LONG_SENTENCE": "Shorten this sentence — consider splitting into two",
    "SHORT_SENTENCE": "Expand this sentence with more detail or context",
    "PASSIVE_VOICE": "Replace passive voice with active construction",
    "HIGH_HEDGE_COUNT": "Remove hedging language to sound more confident",
    "LOW_DENSITY": "Add more content words — reduce filler and function words",
    "VAGUE": "Add specific details, numbers, or named entities",
    "LOW_COHERENCE": "Improve the transition to the next sentence",
    "AI_PATTERN": "Vary sentence structure to sound more natural",
    "AVOID_WORD_HIT": "Replace prohibited vocabulary with an approved alternative",
    "FORMAL_IN_CASUAL": "Use less formal language to match the casual persona",
    "CASUAL_IN_FORMAL": "Remove contractions and use formal register",
    "REDUNDANT": "Remove or merge this sentence — it repeats an earlier point",
}
IMPACTS = {"error": 0.9, "warning": 0.7, "suggestion": 0.4}
