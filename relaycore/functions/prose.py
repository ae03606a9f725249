"""Prose operators as Column expressions: clean-up, sentences, salience, telegraph style."""

from pyspark.sql import Column, functions as F

from .tokens import SPACE

# Phrases without information, and word lists.
FILLERS = (
    r"please note that\s+",
    r"it should be noted that\s+",
    r"as previously mentioned,?\s+",
    r"as mentioned earlier,?\s+",
    r"as you can see,?\s+",
    r"needless to say,?\s+",
    r"i would like to point out that\s+",
    r"i want to emphasize that\s+",
    r"to be honest,?\s+",
    r"basically,?\s+",
    r"essentially,?\s+",
    r"certainly!\s*",
    r"of course!\s*",
    r"sure thing!\s*",
    r"great question!\s*",
)
STOP_WORDS = "a an the and or but if then else of to in on at by for with from as is are was were be been being it its this that these those there here not no yes do does did have has had will would can could should may might into over under about we you they he she i our your their his her them us".split()
NEGATIONS = "not no never none nor cannot can't don't doesn't didn't won't isn't aren't wasn't without".split()
DROPPABLE = "a an the please kindly is are was were".split()
QUALIFIERS = "very really quite rather fairly somewhat broadly generally basically essentially actually certainly definitely simply just".split()
REQUIREMENTS = r"(?iu)(?U)\b(must|require[sd]?|requirement|constraint|deadline|never|always|exceed|exclude[sd]?|at (?:most|least)|no later|before|hard)\b"
SENTENCE_BREAK = r"""(?<=[.!?])\s+(?=[A-Z"'(\[])"""


def normalize_whitespace(text: Column) -> Column:
    for pattern, new in ((r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        text = F.regexp_replace(text, pattern, new)
    return text


def remove_fillers(text: Column) -> Column:
    """The fillers taken out in order; sentence heads keep their case."""
    for pattern in FILLERS:
        text = F.regexp_replace(text, "(?iu)" + pattern.replace(r"\s", SPACE), "")
    return text


def recapitalize(text: Column) -> Column:
    """ASCII letters at the start and after a full stop and white space in upper case."""
    head = lambda s: F.when(s.rlike("^[a-z]"), F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))).otherwise(s)
    gap = r"(?<=[.!?]" + SPACE + r")(?!" + SPACE + ")"
    return F.array_join(F.transform(F.split(text, gap), head), "")


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_BREAK)


def content_words(text: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def salience(text: Column) -> Column:
    points = ((r"\p{Nd}", 0.6), (REQUIREMENTS, 0.6), ("(?<=[a-z,;] )[A-Z][a-z]+", 0.3))
    return sum((F.when(text.rlike(p), w).otherwise(0.0) for p, w in points), F.lit(0.0))


def qualifier_sequence(text: Column) -> Column:
    pattern = r"(?iu)(?U)\b(?:" + "|".join(QUALIFIERS) + r")\b"
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)


def telegraph(text: Column) -> Column:
    """Articles and copulas dropped, unless the word before is a negation."""
    gaps = F.regexp_extract_all(text, F.lit(SPACE + "+"), F.lit(0))
    words = F.split(text, SPACE + "+")
    negation, drop = F.array(*map(F.lit, NEGATIONS)), F.array(*map(F.lit, DROPPABLE))
    core = lambda w: F.lower(F.regexp_replace(w, r"""^[.,;:!?()"']+|[.,;:!?()"']+$""", ""))

    def build(pair):
        ws, gs = pair["w"], pair["g"]
        kept = F.transform(ws, lambda w, i: F.concat(F.when(F.array_contains(drop, w) & ~F.coalesce(F.array_contains(negation, core(F.get(ws, i - 1))), F.lit(False)), "").otherwise(w), F.coalesce(F.get(gs, i), F.lit(""))))
        return F.array_join(kept, "")

    # Words and gaps are bound once for the whole text.
    bound = F.get(F.transform(F.array(F.struct(words.alias("w"), gaps.alias("g"))), build), 0)
    return F.regexp_replace(F.regexp_replace(bound, r"[ \t]{2,}", " "), " ([.,;:!?])", "$1")
