"""Fixed values that results depend on."""

# Headers that open a solutions section, in lower-case letters and digits only.
SOLUTION_HEADERS = (
    "solution", "solutions", "answer", "answers", "answerkey", "answerskey", "answersolution", "answersolutions",
    "answerssolutions", "answerandsolution", "answerandsolutions", "answersandsolutions", "hintssolution",
    "hintssolutions", "hintandsolution", "hintsandsolutions", "detailedsolution", "detailedsolutions", "explanation",
    "explanations", "solutionsexplanations", "answerexplanation", "answerexplanations", "key", "keysolution",
    "keysolutions", "solutionkey", "hints", "hint", "hintsolution", "answerwithsolution", "answerswithsolutions",
    "answerwithexplanation", "answerswithexplanations", "solutionandanswer", "solutionsandanswers",
)
# Headers of a bare answer key.
KEY_HEADERS = ("answerkey", "answerskey", "key", "solutionkey", "keysolution", "keysolutions")
# Hosts and phrases of branding.
BRANDING_HOSTS = (
    "play.google.com", "apps.apple.com", "itunes.apple.com", "pw.live", "penpencil.co", "physicswallah", "onelink.me",
    "bit.ly", "linktr.ee",
)
BRANDING_TEXT = r"(?i)(android\s*app|ios\s*app|pw\s*website|download\s*app|play\s*store|app\s*store)"
FURNITURE_TEXT = r"(?i)(penpencil\.co|qbg-admin|print-preview|\bpw\.live\b|physicswallah)"
# Letters that OCR takes for digits, and the digits.
OCR_LETTERS = "OoQDIli|!ZzEASsGbTBgq"
OCR_DIGITS = "000011111223455667899"
# Page formats in millimetres.
FORMATS = (("A3", 297, 420), ("A4", 210, 297), ("A5", 148, 210), ("Letter", 216, 279), ("Legal", 216, 356), ("Tabloid", 279, 432))

# Patterns for markers, headers and folios, in the syntax that Java's and RE2's engines share.
STRONG = r"(?i)^\s*q(?:ues(?:tion)?)?[.\s]?\s*(?:no[.\s:]*)?\s*[-:]?\s*(\d{1,3})\b"
WEAK_DOT = r"^\s*(\d{1,3})\s*[.](?:\s|$)"
WEAK_PAREN = r"^\s*(\d{1,3})\s*[)](?:\s|$)"
WEAK_OPEN = r"^\s*(\d{1,3})\s*[.]\s*\("
SECTION = r"(?i)^\s*(?:part|section)\s*[-–—:.]?\s*([ivxlcdm]+|[a-z]|\d{1,2})\b|^this\s+section\s+contains\b"
FOLIO = r"(?i)^(?:\d{1,4}|\d{1,4}\s*/\s*\d{1,4}|page\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?|[-–—]\s*\d{1,4}\s*[-–—])$"
PAGE_OF = r"(?i)^\s*(?:page\s*)?\d{1,3}\s*(?:/|of)\s*\d{1,3}\s*$"
OPTION_START = r"^\s*\(?\s*[A-Da-d]\s*[.)]"
KEY_CELL = r"^\s*(\d{1,3})\s*[.)\-:]?\s*\(?\s*([A-Ea-e1-5])\s*\)?\s*$"
# Key pairs, openers of numbered solutions, labelled answers.
KEY_PAIR = r"(?i)(?:^|[\s,;|])(?:Q\.?\s*)?(\d{1,3})\s*[.)\-:]?\s*\(?\s*([A-D])\s*\)?(?=$|[\s,;|])"
SOLUTION_OPENER = r"(?i)^\s*(?:(?:Q|Sol(?:ution)?|Ans(?:wer)?)\.?\s*(\d{1,3})|(\d{1,3})\s*[.)])"
LABELLED_ANSWER = r"(?i)\b(?:ans(?:wer)?|correct\s*(?:option|answer|choice)?|sol(?:ution)?|key|option)\b\s*(?:is|:|-|=|\.|\))*\s*\(?\s*([A-D])\s*\)?(?:[^A-Za-z]|$)"

# Names of classes that a detector's boxes may have.
QUESTION_CLASSES = (
    "q", "question", "questions", "mcq", "mcq_question", "question_box", "question_block", "questionanswerblock",
    "question_answer_block", "question-answer-block", "question answer block",
)
SOLUTION_CLASSES = (
    "s", "solution", "solutions", "answer_block", "answer-block", "answer block", "answer_solution", "explanation",
    "solution_box", "description", "solution_block", "answer_explanation",
)


def quoted(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)
