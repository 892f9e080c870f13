"""Personal data by patterns, checksums and context words, in DataFrame functions only.

Patterns propose spans; validators confirm them: Luhn for card numbers, part values for addresses, digit counts for
phone numbers, modulo 97 for account numbers (IBAN). An account number is found by its first four characters; its end
is the last end of a group of characters, or of the whole run, at which the number is right, so words that follow it don't hide it.
Words near a span raise or lower its score; kinds with a weak shape of their own (social security numbers, account numbers
in small letters) need such a word to pass ``THRESHOLD``. All work runs inside Spark's own expressions, on whole texts.

A text's matches of a kind come from ``regexp_extract_all``, their places from the lengths of the gaps that ``split``
leaves with the same pattern. Repeats are possessive wherever that can't change a match, so a very long run of one
kind of character takes linear time and no stack.

Defined results: null and empty texts have no spans. Matches of one kind never overlap; those of different kinds may.
Matches that a validator rejects are dropped and, but for account numbers, not tried again at a shorter length. Places count
code points. A very long text is one row, worked on whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points on either side of a span in which context words are looked for, and the score a span must reach.
CONTEXT_CHARS, THRESHOLD = 40, 0.5
#: What a context word adds, and what a word against takes away.
RAISE, LOWER = 0.35, 0.3

_LOCAL = "A-Za-z0-9._%+-"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """A kind of span: what must be in a text at all, the pattern, the validator, the base score and its words."""

    name: str
    needs: str
    pattern: str
    score: float
    base: bool
    for_words: str
    against_words: str = ""


#: In the order in which spans at one place are listed.
KINDS = (
    # a match begins where a run of local characters begins, or where the last match ended
    Kind("email", "@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, True, "mail|write to|contact"),
    Kind("ip", ".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.7, True, r"\bip\b|address|host|server", "version|release"),
    Kind("card", "", r"[0-9](?:[\x20-]?[0-9]){11,}+", 0.8, True, "card|visa|credit|karte|tarjeta|carte", "isbn|order no"),
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, True, "phone|call|tel|mobile|fax", ""),
    Kind("iban", "", r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?=[A-Za-z0-9]{11}|\x20[A-Za-z0-9]{4}\x20[A-Za-z0-9]{4}(?![A-Za-z0-9]))", 0.8, False, "iban|account|konto|compte|cuenta|bank"),
    Kind("ssn", "-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, False, r"ssn|social security", ""),
)


#: The most characters of an account number, blanks included, and what may be one: a run, or groups of four and a shorter last one.
_IBAN_CHARS = 42
_IBAN = r"^[A-Za-z]{2}[0-9]{2}(?:[A-Za-z0-9]{11,30}|(?:\x20[A-Za-z0-9]{4}){2,7}(?:\x20[A-Za-z0-9]{1,3})?)(?![A-Za-z0-9])"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: every second digit from the right is doubled."""
    each = F.split(F.reverse(digits), "(?!^)(?!$)")
    value = F.transform(each, lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")).otherwise(d.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without blanks passes modulo 97: the first four characters go last, letters count from 10."""
    moved = F.split(F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4)), "(?!^)(?!$)")
    code = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(moved, F.lit(0), lambda a, c: (a * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97)
    return rest == 1


def _valid(kind: Kind, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    count = F.length(digits)
    if kind.name == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind.name == "card":
        return count.between(12, 19) & luhn(digits)
    if kind.name == "phone":
        return count.between(9, 15)
    if kind.name == "iban":
        return F.length(match) > 4
    if kind.name == "ssn":
        return ~match.rlike("^(?:000|666|9..)-|-00-|-0000$")
    return F.lit(True)


def _account(text: Column, begin: Column) -> Column:
    """The longest right account number that begins at a place and ends where one of its groups does; '' if there is none."""
    most = F.regexp_extract(F.substring(text, begin + 1, F.lit(_IBAN_CHARS + 1)), _IBAN, 0)
    groups = F.split(most, " ")
    sizes = F.when(F.size(groups) < 3, F.array(F.size(groups))).otherwise(F.sequence(F.size(groups), F.lit(3), F.lit(-1)))
    numbers = F.transform(sizes, lambda k: F.array_join(F.slice(groups, 1, k), " "))

    def right(number: Column) -> Column:
        plain = F.upper(F.replace(number, F.lit(" "), F.lit("")))
        return F.length(plain).between(15, 34) & mod97(plain)

    return F.when(most == "", F.lit("")).otherwise(F.coalesce(F.get(F.filter(numbers, right), F.lit(0)), F.lit("")))


def _score(kind: Kind, text: Column, start: Column, end: Column) -> Column:
    """The kind's score, changed by words near the span."""
    near = F.lower(F.concat_ws(" ", F.substring(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS))),
                               F.substring(text, end + 1, F.lit(CONTEXT_CHARS))))
    score = F.lit(kind.score) + F.when(near.rlike(kind.for_words), RAISE).otherwise(0.0)
    if kind.name == "iban":  # small letters are more often a word than a country
        score = score - F.when(F.substring(text, start + 1, F.lit(2)).rlike("[a-z]"), RAISE).otherwise(0.0)
    if kind.against_words:
        score = score - F.when(near.rlike(kind.against_words), LOWER).otherwise(0.0)
    return F.round(F.least(score, F.lit(1.0)), 4)


def _spans(kind: Kind, order: int, text: Column) -> Column:
    """Array of (start, rank, kind, end, match, score) of one kind."""
    matches, gaps = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)
    pairs = F.filter(F.arrays_zip(matches.alias("m"), gaps.alias("g")), lambda p: p["m"].isNotNull())  # the last gap has no match
    # running (place, spans): a gap and a match are passed at each step
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("last"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("found"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["g"])
        end = begin + F.length(pair["m"])
        if kind.name == "iban":  # what was matched is its beginning only
            number = F.when(begin >= state["last"], _account(text, begin)).otherwise(F.lit(""))
            span = F.struct(begin.alias("start"), (begin + F.length(number)).alias("end"), number.alias("match"))
        else:
            span = F.struct(begin.alias("start"), end.alias("end"), pair["m"].alias("match"))
        valid = _valid(kind, span["match"])
        found = F.when(valid, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(end.alias("at"), F.when(valid, span["end"]).otherwise(state["last"]).alias("last"), found.alias("found"))

    confirmed = F.aggregate(pairs, start, step, lambda state: state["found"])
    full = F.transform(confirmed, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("rank"), F.lit(kind.name).alias("kind"), s["end"].alias("end"),
        s["match"].alias("match"), _score(kind, text, s["start"], s["end"]).alias("score")))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,match:string,score:double>>")
    needed = F.contains(text, F.lit(kind.needs)) if kind.needs else F.lit(True)
    return F.when(needed & text.rlike(kind.pattern), full).otherwise(none)


def spans_column(text: Column) -> Column:
    """All confirmed spans of a text by place, with scores; base kinds always, others from ``THRESHOLD`` on."""
    all_ = F.concat(*[_spans(kind, i, text) for i, kind in enumerate(KINDS)])
    own = [k.name for k in KINDS if k.base]
    return F.array_sort(F.filter(all_, lambda s: s["kind"].isin(own) | (s["score"] >= THRESHOLD)))


def _of(spans: Column, names: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(names))


def with_spans(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """Add the array of spans (start, rank, kind, end, match, score) of every text."""
    return docs.withColumn(name, spans_column(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def span_list(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, list of all spans."""
    found = with_spans(docs.select("doc_id", "text"), "text", "__spans").select("doc_id", "__spans")
    own = [k.name for k in KINDS if k.base]
    base = _of(F.col("__spans"), own)
    counts = [F.size(_of(F.col("__spans"), [name])).cast("bigint").alias(f"n_{name}") for name in own]
    return found.select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("__spans")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, and ``n_chars`` (where there is one) counted anew.

    Of overlapping spans the one that begins first is named; the rest of the others is taken out with it. A null text
    stays null.
    """
    found = with_spans(docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("__text")), "__text", "__spans")
    text = F.coalesce(F.col("__text").cast("string"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.greatest(s["start"] - state["at"], F.lit(0))
        new = F.concat(state["out"], F.substring(text, state["at"] + 1, gap), F.when(s["start"] >= state["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), new.alias("out"))

    whole = F.aggregate("__spans", start, step, lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))))
    changed = F.when(F.size("__spans") > 0, whole).otherwise(F.col("__text"))
    types = dict(docs.dtypes)
    columns = []
    for c in docs.columns:
        value = F.col("__row").getField(c)
        if c == "text":
            value = F.col("__new")
        elif c == "n_chars":
            value = F.when(F.size("__spans") > 0, F.length("__new")).otherwise(value).cast(types[c])
        columns.append(value.alias(c))
    return found.withColumn("__new", changed).select(*columns)
