"""Every pattern, word list and message with a prescribed value.

The patterns avoid ``\\s``, ``\\d`` and ``\\b`` wherever those differ between regex dialects, and name
the characters instead. ``\\w`` is ASCII everywhere.
"""

# ---------------------------------------------------------------- fixed values: white space
# ECMAScript white space (trim, \s) and Python white space (strip, split, \s), as regex class bodies.
# The separator category is one table lookup in the JVM; the same set spelled out as ranges is ten times slower.
JS_SPACE = r"\p{Z}\x{9}-\x{d}\x{feff}"
PY_SPACE = r"\p{Z}\x{9}-\x{d}\x{1c}-\x{1f}\x{85}"


def _members(*ranges: tuple[int, int]) -> str:
    return "".join(chr(c) for low, high in ranges for c in range(low, high + 1))


# The same two sets as plain characters, for trimming.
JS_SPACE_CHARS = _members((0x9, 0xD), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                          (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
PY_SPACE_CHARS = _members((0x9, 0xD), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                          (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))

# Line breaks recognised by Python's universal splitting.
PY_LINE_BREAK = r"\r\n|[\x{a}\x{b}\x{c}\x{d}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}-\x{2029}]"
PY_LINE_BREAK_CHARS = _members((0xA, 0xD), (0x1C, 0x1E), (0x85, 0x85), (0x2028, 0x2029))

# ---------------------------------------------------------------- fixed values: page quality
ODD_LINE_BREAK = r"\w\n\w"
MISSING_SPACE = r"[a-z][A-Z]"
SPECIAL_CHAR = rf"""[^\w{JS_SPACE}\-.,;:'"!?()\[\]{{}}]"""
SHORT_WORD = r"(?<!\w)\w{1,2}(?!\w)"
NUMBER_RUN = r"[0-9]{3,}"
PAGE_END_MARK = r"--- END OF PAGE [0-9]+ ---"

ISSUE_SHORT = "Texto muito curto"
ISSUE_ODD_BREAKS = "Quebras de linha suspeitas"
ISSUE_MISSING_SPACES = "Possível falta de espaços"
ISSUE_SPECIAL_CHARS = "Muitos caracteres especiais"
ISSUE_FRAGMENTED = "Palavras muito fragmentadas"

FALLBACK_SHORT = "Texto muito curto para OCR"
FALLBACK_FEW_WORDS = "Muito poucas palavras"
FALLBACK_ODD_BREAKS = "Quebras estranhas"
FALLBACK_PLACEHOLDER = "Caracteres de placeholder"
FALLBACK_NON_ASCII = "Caracteres não-ASCII no início"

PROBE_SHORT = "Texto muito curto - possível falha na extração"
PROBE_SPECIAL = "Caracteres problemáticos encontrados: "
PROBE_NUMBERS = "Sequências numéricas suspeitas: "
PROBE_BREAKS = "Quebras de linha suspeitas: "

SUFFICIENT = "TEXTO_SUFICIENTE - Não precisa de OCR"
LITTLE_TEXT = "POUCO_TEXTO - Pode precisar de correção"
NO_TEXT = "SEM_TEXTO - Precisa de OCR"

# Page status and extraction method values.
PENDING, PROCESSING, CORRECTING, COMPLETED, ERROR = (
    "Pending", "Processing OCR", "AI Correction", "Completed", "Error")
QUICK_TEXT, AI_CORRECTION, AI_OCR = "Quick Text", "AI Correction", "AI OCR"

# ---------------------------------------------------------------- fixed values: outline
MAIN_HEADING = rf"(?i)^(SECTION|CHAPTER|PART|TITLE|BOOK)[{JS_SPACE}]+[A-Z0-9]+"
SUB_HEADING = rf"(?i)^(Section|Article|Clause)[{JS_SPACE}]+[0-9]+(\.[0-9]+)*"
NUMBERED_HEADING = rf"^[0-9]+\.[{JS_SPACE}]+[A-Z]"
ANNEX_HEADING = r"(?i)^(ANNEX|APPENDIX|ATTACHMENT)"
ALL_CAPS_TITLE = rf"^[A-Z{JS_SPACE}]{{5,}}\z"
ALL_CAPS_BREAK = rf"^[A-Z{JS_SPACE}]{{10,}}\z"
DEFINITIONS_HEADING = r"(?i)^(DEFINITIONS?|TERMS)"
CLOSING_LINE = "|".join(f"(?:{p})" for p in (
    MAIN_HEADING, SUB_HEADING, NUMBERED_HEADING, ANNEX_HEADING, ALL_CAPS_BREAK))
OPENING_LINE = "|".join(f"(?:{p})" for p in (
    MAIN_HEADING, SUB_HEADING, NUMBERED_HEADING, ANNEX_HEADING, ALL_CAPS_TITLE, DEFINITIONS_HEADING))
TOC_BANNER = "TABLE OF CONTENTS\n==================\n\n"

# ---------------------------------------------------------------- fixed values: tags and footnotes
TAGGED_BLOCK = r"(?s)<h>.*?</h>|<li>.*?</li>|<p>.*?</p>"
TAGGED_BLOCK_ONE_LINE = (r"<h>[^\n\r\x{2028}-\x{2029}]*?</h>|<li>[^\n\r\x{2028}-\x{2029}]*?</li>"
                         r"|<p>[^\n\r\x{2028}-\x{2029}]*?</p>")
STRUCTURE_TAG = r"</?(h|li|p)>"
NOTE_TAG = r"(?s)<fn>(.*?)</fn>"
NOTE_TOKEN = r"__FOOTNOTE_REF_([0-9]+)__"
NOTE_ORIGINAL_MARK = r"^([\[\(]?[0-9]{1,3}[\]\)]?|[¹²³⁴⁵⁶⁷⁸⁹⁰]+)"
NOTE_LEADING_MARK = (rf"^[{JS_SPACE}]*([0-9]+[{JS_SPACE}]*|\*[{JS_SPACE}]*|\[[0-9]+\][{JS_SPACE}]*"
                     rf"|\([0-9]+\)[{JS_SPACE}]*|[a-zA-Z][{JS_SPACE}]+)")
NOTE_DEFINITION = r"(?s)\{\{footnote(\p{Nd}+)\}\}(.*?)\{\{-footnote\p{Nd}+\}\}"
NOTE_REFERENCE = r"\{\{footnotenumber(\p{Nd}+)\}\}"
NOTE_REFERENCE_CLOSE = r"\{\{-footnotenumber\p{Nd}+\}\}"
NOTE_MARKER = r"<fn>[^\n\r\x{2028}\x{2029}]*?</fn>|\{\{footnote[0-9]+[^\n\r\x{2028}\x{2029}]*?\}\}"
NOTE_SECTION_TITLE = "\n\nFOOTNOTES:\n"

# ---------------------------------------------------------------- fixed values: correction replies
CHANGES_BLOCK = r"---CHANGES MADE---(.*?)---END CHANGES---"
CHANGES_NONE = "---NO CHANGES NEEDED---"
ANALYSIS_BLOCK = r"---OCR ANALYSIS---(.*?)---END ANALYSIS---"
ANALYSIS_CLEAN = "---CLEAN EXTRACTION---"
NOTE_NO_CHANGES = "No changes needed"
NOTE_CHANGES_MISSING = "Changes summary not provided"
NOTE_CLEAN = "Clean extraction - no issues found"
NOTE_ANALYSIS_MISSING = "OCR analysis not provided"
NOTE_NO_TEXT = "No text to process"

# ---------------------------------------------------------------- fixed values: legal layout
UPPER_HEADINGS = """
part book annex appendix schedule preamble chapter division subpart
parte libro anexo apéndice preámbulo capítulo división subparte
livro apêndice preâmbulo divisão
partie livre annexe appendice préambule chapitre sous-partie
teil buch anhang anlage kapitel unterteil
section article title título sección secção artículo artigo
""".split()
TITLE_HEADINGS = """
title section subsection article clause regulation rule order paragraph
título sección subsección artículo cláusula reglamento regla orden párrafo apartado
secção seção subsecção subseção artigo regulamento regra ordem parágrafo art.
titre sous-section règlement règle ordonnance paragraphe
titel abschnitt unterabschnitt artikel klausel regelung verordnung regel anordnung absatz
chapter division
""".split()
AMBIGUOUS_HEADINGS = "rule order paragraph clause regulation".split()
PREAMBLE_TITLE = "preamble"
PREAMBLE_INTROS = ["Members,"]
PREAMBLE_STARTERS = [
    "Noting", "Considering", "Recognizing", "Recognising", "Recalling", "Desiring", "Affirming",
    "Having carried out", "Striving", "Believing", "Whereas", "The Governments of", "The Parties",
    "Conscious of", "Mindful of", "Reaffirming",
]
TRANSITIONS = [
    "hereby agree as follows:", "have agreed as follows:", "the parties hereby agree as follows:",
    "agree as follows:", "adopt the following provisions:",
]
_S, _NS = f"[{PY_SPACE}]", f"[^{PY_SPACE}]"
_NUM = r"(?:\p{Nd}+(?:\.\p{Nd}+)*\.|\(\p{Nd}+\))"
_ENUM = r"(?:\([a-z]{1,2}\)|\([ivxlcdm]+\)|[a-z]{1,2}\.|[ivxlcdm]+\.)"
STANDALONE_NUMBER = rf"^{_S}*\p{{Nd}}+{_S}*\z"
QUOTED_NOTE = rf'^\p{{Nd}}+{_S}+["“]'
NUMBERED_ITEM = rf"^{_NUM}{_S}+{_NS}"
NUMBER_MARK = rf"^{_NUM}\z"
NUMBERED_HEAD = r"(?i)^(?:\p{Nd}+|[IVXLCDM]+)\.\z"
NUMERAL = r"(?i)^(?:\p{Nd}+|[IVXLCDM]+)\z"
ENUM_ITEM = rf"(?i)^{_ENUM}{_S}+{_NS}"
ENUM_MARK = rf"(?i)^{_ENUM}\z"
# Every marker and item form starts like this; a quick test that most lines fail.
MARK_LIKE = r"^(?:\(|\p{Nd}|[a-zA-Z]+\.)"
ITEM_START = r"(?i)^(\(?[a-z0-9]+\)|[a-z]{1,2}\.|[ivxlcdm]+\.|\p{Nd}+\.)"
SPLIT_ITEM = rf"(?i)^(\p{{Nd}}+\.){_S}+(\([a-z]{{1,2}}\)){_S}+(.*)\z"
KEY_AND_ID = (rf"(?i)^[a-zA-ZÁÉÍÓÚÑÜÇÀÂÊÎÔÛÄËÏÖÜáéíóúñüçàâêîôûäëïöü]+{_S}+[0-9IVXLCDM]+(?:\.[0-9]+)*"
              rf"{_S}*[:.\-–]?{_S}*\z")

PREAMBLE_HEAD, PREAMBLE_INTRO, PREAMBLE_CLAUSE = "PREAMBLE_HEAD", "PREAMBLE_INTRO", "PREAMBLE_CLAUSE"
TRANSITIONAL, HEADING_UPPER, HEADING_TITLE = "TRANSITIONAL", "HEADING_UPPER", "HEADING_TITLE"
NUMBERED_PARA_HEAD, ENUM_MARKER, NUM_MARKER = "NUMBERED_PARA_HEAD", "ENUM_MARKER", "NUM_MARKER"
ENUM_LINE, NUMBERED_LINE, FOOTNOTE_BLOCK = "ENUM_ITEM", "NUMBERED_ITEM", "FOOTNOTE_BLOCK"
ENDS_COLON, REGULAR, SPLIT_MARKER_PARENT = "ENDS_COLON", "REGULAR", "SPLIT_MARKER_PARENT"

# ---------------------------------------------------------------- fixed values: logs and runs
NOISE_SOURCE, NOISE_MESSAGE, NOISE_PREFIX = "debug-api", "Logs requested", "GET /api/debug"
RECOVERABLE_ERROR = r"(?i)network|timeout|rate limit|temporary|service unavailable"
RETRIABLE_WORDS = ["429", "RESOURCE_EXHAUSTED", "timeout"]
OCR_ISSUE_WORDS = ["No text extracted", "Nenhum texto", "páginas needing correction: []", "no AI correction needed"]
DETECTION_WORDS = ["problematicPages", "critério adicional", "análise local"]
SEVERITY_WORDS = [("error", ["ERROR", "❌"]), ("warning", ["WARNING", "⚠️"]), ("success", ["SUCCESS", "✅"])]
PHASE_WORDS = {4: ["Phase 4", "🎨"], 3: ["Phase 3", "⚡"], 2: ["Phase 2", "🧠"], 1: ["Phase 1", "🚀"]}
PHASE_WORDS_FIVE = {5: ["Phase 5", "🎨"], 4: ["Phase 4", "🔖"], 3: ["Phase 3", "⚡"],
                    2: ["Phase 2", "🧠"], 1: ["Phase 1", "🚀"]}
CALCULATING, CALCULATING_PT = "Calculating...", "Calculando..."
AGE_RECENT = "há pouco tempo"
UNKNOWN_FILE, UNKNOWN_STEP = "Arquivo desconhecido", "Desconhecido"
TERMINAL_STATES = ["completed", "failed"]
