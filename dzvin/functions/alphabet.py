"""Fixed values of the Ukrainian stress rules: letters, marks, word lists and patterns."""

ACUTE, BREVE, DIAERESIS = "́", "̆", "̈"

# The alphabet, its vowels, and what stands for an apostrophe or a hyphen.
LETTERS = "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя"
VOWELS = "аеєиіїоуюя"
APOSTROPHE = "ʼ"
APOSTROPHES = "'`‘’ʻ＇"
HYPHENS = "‐‑‒–—−"
#: Joined inside a word / part a word into segments.
JOINERS = "-'ʼ’‘ʻ`＇‐‑‒–—−"
BREAKS = "-‐‑‒–—−"
#: Passed over, and looked for, when deciding whether a word opens a sentence.
OPENERS = "«»\"'„“”‘’()[]—–-"
ENDERS = ".!?…:"

# Pronouns whose stress moves to the first vowel after a preposition, and those prepositions.
SHIFTED_PRONOUNS = ["мене", "тебе", "себе", "нього", "неї", "нею", "ними"]
PREPOSITIONS = (
    "без біля в від для до за з зі із коло крізь круг між на над о об округ перед під по повз "
    "поза поміж попри при про серед у через од"
).split()

# Numerals that take a counted form, their cases, and the particles a phase verb may stand before.
COUNTED_NUMERALS = ["два", "дві", "три", "чотири", "обидва", "обидві"]
COUNTED_CASES = ["Nom", "Acc"]
PARTICLES = ["не", "б", "би", "ж", "же"]
PHASE_VERBS = (
    "почати почав почала почало почали починати починає починають починав починала починали "
    "стати став стала стало стали "
    "продовжити продовжив продовжила продовжили продовжувати продовжував продовжувала продовжували продовжує продовжують "
    "перестати перестав перестала перестали переставати "
    "припинити припинив припинила припинили припиняти "
    "закінчити закінчив закінчила закінчили "
    "взятися взявся взялася взялися братися береться"
).split()

# Abbreviations that do not end a sentence and are read out.
ABBREVIATIONS = (
    "р рр ст стст в вв м с сс сел смт вул просп бульв пров пл наб обл р-н тис млн млрд грн коп дол євро шт зам вид "
    "перекл упоряд див напр тобто т ім акад проф доц канд докт ред гол зав буд кв корп каб оф под пн пд сх зх "
    "хв год сек кг мг км см мм куб"
).split()

# Parts of speech that stand for each other, features that tell accents apart, numbering of bundles.
EQUIVALENT_UPOS = {"PRON": ["PRON", "DET"], "DET": ["DET", "PRON"], "NOUN": ["NOUN", "PROPN"], "PROPN": ["PROPN", "NOUN"]}
RELIABLE_FEATURES = ["Case", "Number", "Gender", "Animacy"]
SUPPLEMENTARY, REVIEWED, EXCLUSIVE = (5, 7, 9, 10, 12, 13, 16, 18, 19), (12, 13), (13, 18)
SCHEMA_VERSION, NORMALIZATION_VERSION = 1, "ukstress-nfd-v1"

#: Character classes for patterns that Java and RE2 share.
LETTER = "[А-Яа-яЄєІіЇїҐґ]"
MARKS = "\\p{Mn}"
JOINER_CLASS = "[\\-'ʼ’‘ʻ`＇‐‑‒–—−]"
_INNER = f"А-Яа-яЄєІіЇїҐґ{MARKS}"
#: A letter, then letters, marks and joiners up to the last letter or mark. Plain classes, since Java's patterns recurse in groups.
WORD = f"(?:{LETTER}[{_INNER}{JOINER_CLASS[1:-1]}]*[{_INNER}]|{LETTER})"
#: A vowel as signatures count it: the letter whose first decomposed code point is a vowel, so й counts.
COUNTED = "АЕЄИІЇОУЮЯЙЁаеєиіїоуюяйё"
BREAK_CLASS = "\\-‐‑‒–—−\\s"
#: A word falls into units: up to a vowel with its marks, up to a break, or the rest.
UNIT = f"[^{COUNTED}{BREAK_CLASS}]*[{COUNTED}]{MARKS}*|[^{COUNTED}{BREAK_CLASS}]*[{BREAK_CLASS}]|[^{COUNTED}{BREAK_CLASS}]+"
