"""Constants, patterns and word lists whose exact form decides results.

All patterns are written in the regular dialect that the JVM and Python share; matches are of whole
lines unless a name says otherwise.
"""

# --- fixed values: sizes and limits -------------------------------------------------------
TARGET_TOKENS = 250
HARD_MAX_TOKENS = 300
MIN_PREFERRED_TOKENS = 180
MIN_USEFUL_TOKENS = 80
MAX_OVERLAP_TOKENS = 24
MAX_CHUNKS = 1000
MARGIN_LINES = 3
MARGIN_RATIO = 0.60
MAX_INDENT = 40
DEFAULT_TOP_K = 5
MAX_TOP_K = 20
CANDIDATES = 20
RRF_K = 60
OVERLAP_THRESHOLD = 0.60
SHINGLE_WORDS = 5
MAX_DOCUMENTS = 3
MEMORY_COMPACT_ABOVE = 12
MEMORY_KEEP = 8
BASIC_CHAT_WINDOW = 20
TITLE_LENGTH = 80
QUESTION_TITLE_LENGTH = 60
DEFAULT_TITLE = "New chat"
EMBEDDING_DIMENSIONS = 768
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
FIELD_BOOSTS = {"section_title": 4.0, "subsection_titles": 3.0, "heading_path": 2.0, "content": 1.0}
BM25_K1 = 1.2
BM25_B = 0.75

# --- fixed values: patterns ---------------------------------------------------------------
HORIZONTAL_SPACE = r"[\p{Zs}\t\x0B\f]+"
#: a whole line of words with one plain blank between them, or an empty one; none of the signs that the JVM takes for a line's end
NORMAL_LINE = r"\A(?:[^\s\p{Zs}\x85\u2028\u2029]++(?: [^\s\p{Zs}\x85\u2028\u2029]++)*+)?\z"
PAGE_COUNTER = r"(?i)\bpage\s+\d+\s+(?:of|/)\s*\d+\b"
PAGE_COUNTER_TEXT = "page # of #"
STANDALONE_PAGE_NUMBER = r"(?i)^\s*(?:page\s+)?[-–—]?\s*(?:\d+|[ivxlcdm]+)(?:\s*(?:of|/)\s*\d+)?\s*[-–—]?\s*$"
NUMBERED_HEADING = r"^(\d+(?:\.\d+)*)[.)]?\s+(.+)$"
MARKDOWN_HEADING = r"^(#{1,6})\s+(.+)$"
CHILD_HEADING = r"(?i)^(?:concept|how it works|practical considerations?|examples?|engineering notes?|chunking checkpoints?)$"
BULLETS = "-*•‣◦▪▫●○■□‒–—⁃∙"
LIST_LINE = r"^(?:[-*•‣◦▪▫●○■□‒–—⁃∙]|\d+[.)]|[A-Za-z][.)])\s+.+$"
HEADING_STOPS = ".?!;:{}"
HEADING_WORDS = 14
HEADING_CHARS = 140
CODE_WORDS_CLEANING = "public private protected static final abstract class interface enum record void return if else for while try catch package import throw throws".split()
CODE_WORDS_CHUNKING = "public private protected static final abstract sealed class interface enum record void return if else for while switch case try catch finally package import throw throws".split()
#: assignments (words, a name, =, something, ;) and calls; written without nested repeats, so that long lines cost no stack
CODE_CALL = r"^(?:[\w.$<>?\[\],][\w.$<>?\[\],\s]*\s\w+\s*=.+;|[\w.$]+\s*\([^;]*\);)$"
BLOCK_BREAK = r"(?:\R\s*){2,}"
NOT_WORD = r"[^\p{L}\p{N}_]+"
#: a word by the Unicode word boundary rules: an ideograph or a Hiragana sign each by itself, a run of Katakana, else letters, digits and joiners like _
#: without a break: letters over one : · . ' ’ between them, digits over one , ; . ' ’ between them; marks go with what they shape
#: possessive and with the frequent case first: no step is ever taken back, and long words cost no stack
_LETTER = r"a-zà-öø-ÿ[\p{L}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]]"
WORD = (
    rf"(?:[{_LETTER}][{_LETTER}\p{{M}}]*+(?:[:·.'’][{_LETTER}][{_LETTER}\p{{M}}]*+)*+|[_‿]++|\p{{Nd}}[\p{{Nd}}\p{{M}}]*+(?:[,;.'’]\p{{Nd}}[\p{{Nd}}\p{{M}}]*+)*+)++|"
    r"[\p{IsHan}\p{IsHiragana}]\p{M}*+|[\p{IsKatakana}ー]++"
)
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
CITATION = r"(?i)\[Source\s+(\d+)((?:\s*,\s*Source\s+\d+)*)\](?!\()"
#: the default token estimate, which SQL can express too
TOKEN = r"\p{L}{1,4}|\p{N}{1,3}|[^\s\p{L}\p{N}]"

# --- fixed values: word lists --------------------------------------------------------------
ENGLISH_STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
CHAT_STAGES = (("UNDERSTANDING", 0, 3), ("SEARCHING", 1, 3), ("GENERATING", 2, 3))
BOUNDARIES = ("document_start", "new_section", "same_section_structural_split", "same_topic_token_limit")


def code_keyword(words: list[str]) -> str:
    return r"^(?:@\w+|(?:" + "|".join(words) + r")\b.*)$"
