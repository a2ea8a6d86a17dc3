"""Functions on texts; all of them are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a token is a number with groups of thousands, or runs of letters and digits joined by hyphens.
TOKEN = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|[a-z0-9]+(?:-[a-z0-9]+)*"


def tokens(text: Column) -> Column:
    """Lower-case tokens in order; commas inside numbers go. Nothing is stemmed. Null for null."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0), lambda t: F.regexp_replace(t, ",", ""))


def phrase_key(text: Column) -> Column:
    """Phrase in lower case without apostrophes; other signs than & ( ) - become single spaces."""
    bare = F.regexp_replace(F.lower(text), "['’]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9&()\- ]", " "), " +", " "))


def digit_key(text: Column) -> Column:
    """Text with runs of digits as # and runs of white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\d+", "#"), r"\s+", " "))


#: Fixed value: where sentences end: a stop, white space, and a capital, digit, bracket or quote.
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9(“\"])"


def sentences(text: Column) -> Column:
    """Sentences of a text."""
    return F.split(text, SENTENCE_END)


def letters_share(text: Column) -> Column:
    """Share of letters of any script among all characters, 0 for an empty text."""
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(text, r"[^\p{L}]", "")), F.length(text)), F.lit(0.0))


def excerpt(text: Column, size: int = 400) -> Column:
    """First characters of a text without the lines that begin with a bracket."""
    return F.substring(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.startswith("[")), "\n"), 1, size)


def redacted(text: Column) -> Column:
    """Text with mail addresses and home folders masked."""
    return F.regexp_replace(F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<mail>"), r"/(?:home|Users)/[^/\s]+", "<home>")


def before_colon(text: Column) -> Column:
    """What stands before the first colon, as the accession of a chunk id."""
    return F.substring_index(text, ":", 1)


def unfenced(text: Column) -> Column:
    """Text without a code fence around it."""
    return F.regexp_replace(F.trim(text), r"^```[a-z]*\s*|\s*```$", "")


def json_with_keys(text: Column, schema: str, keys: list[str]) -> Column:
    """Object parsed from text if it has exactly the given keys, else null."""
    body = unfenced(text)
    same = F.sort_array(F.json_object_keys(body)) == F.array(*[F.lit(k) for k in sorted(keys)])
    return F.when(same, F.from_json(body, schema))


def has_word(text: Column, word: Column) -> Column:
    """Whether a word occurs in text, not inside a longer run of letters; case does not count."""
    return F.regexp_like(F.lower(text), F.concat(F.lit(r"(?<![a-z])\Q"), F.lower(word), F.lit(r"\E(?![a-z])")))


def verbatim(text: Column) -> Column:
    """Text with pipes as spaces and white space collapsed, as quotes are compared."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\|", " "), r"\s+", " "))


def quoted(quote: Column, text: Column) -> Column:
    """Whether a text holds a quote word for word; an empty quote is none."""
    return F.coalesce((verbatim(quote) != "") & F.contains(verbatim(text), verbatim(quote)), F.lit(False))


def clauses(sentence: Column) -> Column:
    """Clauses of a sentence, each with the semicolon that ends it."""
    return F.split(sentence, r"(?<=;)\s+")


#: Phrases that point at the text before a question, and pronouns that need a name before them.
DEICTIC = r"(?i)\b(?:this|these|that|those|the above|the following)\s+(?:table|section|filing|passage|excerpt|chunk|document|paragraph|note|item)\b"
PRONOUN = r"(?i)\b(?:it|its|they|their|them|he|she|his|her|we|our|us)\b"


def unanchored(question: Column, names: Column) -> Column:
    """Whether a question points at a text it does not name: a deictic phrase, or a pronoun before which no name of the array occurs."""
    at = F.regexp_instr(question, F.lit(PRONOUN))
    low = F.lower(question)
    named = F.exists(names, lambda n: F.contains(F.substring(low, F.lit(1), F.greatest(at - 1, F.lit(0))), F.lower(n)))
    return F.coalesce(question.rlike(DEICTIC) | ((at > 0) & ~F.coalesce(named, F.lit(False))), F.lit(False))


def quarter_of_span(question: Column) -> Column:
    """Whether a question puts a quarter's label on a span of several months: both are named."""
    return F.coalesce(question.rlike(r"(?i)\b(?:Q[1-4]|(?:first|second|third|fourth)\s+quarter)\b") & question.rlike(r"(?i)\b(?:six|nine|twelve|[69]|12)\s+months\b"), F.lit(False))


#: Fixed value: clauses by which a table excepts some of its figures from its scale.
SCALE_EXCEPTION = r"(?i)\bexcept\s+(?:for\s+)?(?:per[\s-]share|share|percentages?|ratios?|as\s+(?:otherwise\s+)?(?:noted|indicated))"


def mixed_scales(text: Column, caption: Column, spans: Column) -> Column:
    """Whether the figures of a text may have other scales than its caption says: an exception clause, or a span of another scale; a null scale counts as 0."""
    other = F.size(F.array_except(F.transform(spans, lambda s: F.coalesce(s, F.lit(0))), F.array(F.coalesce(caption, F.lit(0))))) > 0
    return F.coalesce(text.rlike(SCALE_EXCEPTION), F.lit(False)) | F.coalesce(other, F.lit(False))


def attached_scale(value: Column, percent: Column, caption: Column, mixed: Column, span: Column) -> Column:
    """value with the scale of its span, else of the caption where scales are not mixed: value, known. Percentages are never scaled."""
    from quarryline.functions.numbers import apply_scale

    power = F.when(percent, F.lit(0)).when(span.isNotNull(), span).when(~mixed, caption)
    return F.struct(F.when(power.isNull(), value).otherwise(apply_scale(value, power)).alias("value"), power.isNotNull().alias("known"))


def rendered(template: str, slot: str, value: Column) -> Column:
    """Template with its one slot filled; a template without exactly one is an error when the plan is made."""
    if template.count(slot) != 1:
        raise ValueError(f"{slot} occurs {template.count(slot)} times")
    before, after = template.split(slot)
    return F.concat(F.lit(before), value, F.lit(after))


def family(model: Column) -> Column:
    """What stands before the first hyphen of a model's name, in lower case."""
    return F.lower(F.substring_index(model, "-", 1))


def code_version(*modules) -> str:
    """Hash of the sources of modules, by which artefacts of older code are told."""
    import hashlib
    import inspect

    return hashlib.sha256("\x00".join(inspect.getsource(m) for m in modules).encode()).hexdigest()


def scrubbed(record: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """Columns with addresses and home folders masked, and the array of the names of those that changed."""
    clean = {name: redacted(c) for name, c in record.items()}
    touched = F.filter(F.array(*[F.when(~clean[n].eqNullSafe(c), F.lit(n)) for n, c in record.items()]), lambda x: x.isNotNull())
    return clean, touched


#: Words that full-text search leaves out, and suffixes that its stems drop, longest first.
STOP_WORDS = "a an and are as at be by for from has have in is it its of on or that the this to was were what which who will with".split()
SUFFIXES = ("izations", "ization", "ations", "ation", "ments", "ment", "ness", "ings", "ing", "ies", "ied", "ers", "er", "ed", "es", "ly", "s")


def stems(text: Column) -> Column:
    """Words of a text without stop words, each without its longest known suffix where three letters are left.

    Light English stemming by rule: the same word forms meet, without a dictionary.
    """
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda w: ~w.isin(STOP_WORDS))
    return F.transform(words, lambda w: F.regexp_replace(w, f"(?<=[a-z0-9]{{3}})(?:{'|'.join(SUFFIXES)})$", ""))
