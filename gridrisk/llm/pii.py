"""Personal data by rules: regular expressions propose spans, checksums confirm them, context words adjust the score.

Kinds email, ip, card and phone always count once their validator passes. The kinds that the method adds count when
validator and context bring the score to ``THRESHOLD``: iban (mod-97; numbers of a country that the table lacks need a
word nearby), ssn (needs one), and secret (keys of known forms, and values assigned to a name such as password or token
that look random; words such as example nearby speak against them).

The patterns equal the plain ones of their kind in what they match, leftmost and non-overlapping, but are written so
that a run of characters is tried once only: possessive quantifiers, and a look-behind that lets a match start only at
the start of a run or where the last match ended (``\\G``). So a text that is one very long token takes linear time.

Offsets are code points, end exclusive: the gaps around the matches, cut by the same pattern, give the positions.

Positions come from running sums in two levels, the square root of the number of matches each, so that many matches in a
text don't make its time quadratic.

Defined results: a null text is empty and has no spans; overlapping spans of different kinds all count; repeated rows
each get their own result; an empty table gives no rows; columns of any other name pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.llm.common import fresh_name, without

NEAR = 40


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _ip_ok(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))


def _length_ok(match: Column, least: int, most: int) -> Column:
    return F.length(_digits(match)).between(least, most)


def luhn_ok(match: Column) -> Column:
    """The Luhn sum of the digits in match is a multiple of ten."""
    digits = F.reverse(_digits(match))

    def weight(i: Column) -> Column:
        d = F.substr(digits, i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + weight(i))
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(False)


#: Characters of an IBAN by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def iban_pattern() -> str:
    """Numbers of the length of their country, which leave what stands behind them alone; else runs of 15 to 34
    characters, of which iban_length finds the number."""
    by: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by.setdefault(n, []).append(country)
    known = "|".join(f"(?:{'|'.join(c)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by.items()))
    other = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"
    return f"(?<![A-Za-z0-9])(?:{known}|{other})(?![A-Za-z0-9])"


def mod97_ok(match: Column) -> Column:
    """ISO 7064: the first four characters moved behind, letters as 10 to 35, leave 1 modulo 97."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
    return F.when(F.length(plain).between(15, 34), rest == 1).otherwise(False)


def iban_length(match: Column) -> Column:
    """The characters of the longest start of match that ends at a group and that mod-97 confirms, or all of them."""
    ends = F.filter(F.sequence(F.lit(15), F.length(match)), lambda n: F.substr(match, n + 1, F.lit(1)).isin("", " ") & mod97_ok(F.substr(match, F.lit(1), n)))
    return F.coalesce(F.array_max(ends), F.length(match))


@dataclass(frozen=True)
class Kind:
    """marker: a cheap test that any text with a match passes. base: counts whatever the context says."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    marker: Callable[[Column], Column]
    words: str
    base: bool
    score: Callable[[Column], Column]  # of a match that is valid, without context
    length: Callable[[Column], Column] = F.length  # of the span in a match
    against: str = ""


def _flat(score: float) -> Callable[[Column], Column]:
    return lambda m: F.lit(score)


def _iban_score(match: Column) -> Column:
    return F.when(F.left(match, F.lit(2)).isin(*IBAN_LENGTHS), 0.6).otherwise(0.4)


SECRET_NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|client[_-]?secret"
#: Keys that their form gives away.
SECRET_FORMS = "(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{20,}+|sk_live_[A-Za-z0-9]{24,}+|AIza[A-Za-z0-9_-]{35}"
SECRET_VALUE = "[A-Za-z0-9+/=_.~-]"
SECRET = f"(?<![A-Za-z0-9])(?:(?:{SECRET_FORMS})(?![A-Za-z0-9])|(?i:{SECRET_NAMES})[\"']?[ \\t]{{0,3}}[:=][ \\t]{{0,3}}[\"']?{SECRET_VALUE}{{8,}}+)"


def _value(match: Column) -> Column:
    """The value of an assignment, or the key itself."""
    return F.regexp_replace(match, r"^[^:=]*[:=][ \t]*[\"']?", "")


def secret_ok(match: Column) -> Column:
    """A key of a known form, or a value with letters, digits and at least six different characters."""
    value = _value(match)
    kinds = F.size(F.array_distinct(F.split(value, "")))
    return match.rlike(f"^(?:{SECRET_FORMS})$") | (value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 8) & (kinds >= 6))


# The patterns of the kinds and their context words.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), lambda t: t.contains("@"), "mail|email|e-mail|contact|address", True, _flat(0.8)),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip_ok, lambda t: t.rlike(r"[0-9]\.[0-9]"), "ip|host|server|address", True, _flat(0.6)),
    Kind("card", r"[0-9](?:[ -]?[0-9]){12}(?:[ -]?[0-9])*+", lambda m: _length_ok(m, 13, 19) & luhn_ok(m), lambda t: t.rlike("[0-9](?:[ -]?[0-9]){12}"), "card|visa|mastercard|credit|payment", True, _flat(0.7)),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: _length_ok(m, 9, 15), lambda t: t.contains("+"), "phone|tel|call|mobile|fax", True, _flat(0.7)),
    Kind("iban", iban_pattern(), mod97_ok, lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), "iban|bank|account|transfer", False, _iban_score, iban_length, "example|sample|invoice|order"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda m: F.lit(True), lambda t: t.rlike(r"[0-9]-[0-9]"), "ssn|social|security", False, _flat(0.3), F.length, "example|sample|invoice|order"),
    Kind("secret", SECRET, secret_ok, lambda t: t.rlike(f"(?i:{SECRET_NAMES})|{SECRET_FORMS}"), "key|login|credential|credentials|auth", False, _flat(0.6), F.length, "example|sample|placeholder|dummy"),
)
THRESHOLD = 0.5
CONTEXT = 0.2


def scanned(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Of each value of an array, op over all values before it, from zero. Blocks of the square root of the size are
    scanned one by one, then what lies before each block is added."""
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), step), lambda i: F.slice(values, i + 1, step))

    def scan(xs: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    before = scan(F.transform(blocks, lambda b: F.aggregate(b, zero, op)))
    return F.flatten(F.zip_with(blocks, before, lambda b, at: F.transform(scan(b), lambda x: op(at, x))))


def _spans(gaps: Column, matches: Column, ahead: Column, kind: Kind) -> Column:
    """Validated spans (kind, start, end, score) of one kind from the gaps and matches of its pattern and how many
    characters lie before each gap."""

    def span(x: Column, i: Column) -> Column:
        start = x["ahead"] + F.length(F.get(gaps, i))
        own = F.left(x["m"], kind.length(x["m"]))
        near = F.lower(F.concat(F.right(F.get(gaps, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(NEAR))))
        word = lambda words: near.rlike(rf"(?<![a-z])(?:{words})(?![a-z])")
        score = kind.score(own) + F.when(word(kind.words), CONTEXT).otherwise(0.0)
        score = score - F.when(word(kind.against), CONTEXT).otherwise(0.0) if kind.against else score
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(own)).alias("end"), F.when(kind.valid(own), F.round(score, 2)).alias("score"))

    least = 0.0 if kind.base else THRESHOLD
    placed = F.zip_with(matches, ahead, lambda m, a: F.struct(m.alias("m"), a.alias("ahead")))
    return F.filter(F.transform(placed, span), lambda s: s["score"] >= least)


EMPTY = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """docs with ``out``: an array of (kind, start, end, score), by kind as listed in KINDS, then by start. A column
    of the caller with that name is replaced."""
    docs = without(docs, out)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # Every step is a column that the next uses more than once, so that Catalyst doesn't paste it into lambdas.
    gaps, hits, sizes, ahead = ({k.name: fresh_name(docs, f"{step}_{k.name}") for k in KINDS} for step in ("gaps", "hits", "sizes", "ahead"))
    cut = docs.withColumns({gaps[k.name]: F.when(k.marker(text), F.split(text, k.pattern, -1)) for k in KINDS})
    cut = cut.withColumns({hits[k.name]: F.when(F.size(gaps[k.name]) > 1, F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))) for k in KINDS})
    both = lambda k: F.zip_with(F.slice(gaps[k.name], F.lit(1), F.size(hits[k.name])), hits[k.name], lambda g, m: F.length(g) + F.length(m))
    cut = cut.withColumns({sizes[k.name]: F.when(F.size(hits[k.name]) > 0, both(k)) for k in KINDS})
    cut = cut.withColumns({ahead[k.name]: F.when(F.size(sizes[k.name]) > 0, scanned(F.col(sizes[k.name]), F.lit(0), lambda a, b: a + b)) for k in KINDS})
    each = [F.when(F.size(ahead[k.name]) > 0, _spans(F.col(gaps[k.name]), F.col(hits[k.name]), F.col(ahead[k.name]), k)).otherwise(F.array().cast(EMPTY)) for k in KINDS]
    return cut.withColumn(out, F.concat(*each)).drop(*gaps.values(), *hits.values(), *sizes.values(), *ahead.values())


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by ``<KIND>``; overlapping spans share one mark, that of the first. Texts without
    spans, nulls included, stay as they are."""
    found, ordered, ends, hidden = (fresh_name(docs, n) for n in ("pii", "ordered", "ends", "hidden"))
    text, spans, until = F.col(f"`{text_col}`"), F.col(ordered), F.col(hidden)
    docs_ = find_pii(docs, text_col, found)
    # In order of start: the array of structs sorts by its first field, so start comes first here.
    docs_ = docs_.withColumn(ordered, F.when(F.size(found) > 0, F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))))
    docs_ = docs_.withColumn(ends, F.transform(spans, lambda s: s["end"]))
    docs_ = docs_.withColumn(hidden, F.when(F.size(ends) > 0, scanned(F.col(ends), F.lit(0), lambda a, b: F.greatest(a, b))))
    n = F.size(spans)
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))

    def cut(i: Column) -> Column:
        """A block of spans with its part of the text: what a cut costs grows with its distance from the start."""
        base, stop = F.get(until, i), F.least(i + step, n) - 1
        end = F.greatest(F.get(until, stop), F.get(spans, stop)["end"])
        rows = F.zip_with(F.slice(spans, i + 1, step), F.slice(until, i + 1, step), lambda s, at: F.struct(s["start"].alias("start"), at.alias("at"), s["kind"].alias("kind")))
        return F.struct(base.alias("base"), F.substr(text, base + 1, end - base).alias("part"), rows.alias("rows"))

    def masked(block: Column) -> Column:
        """What stays in front of each span of a block, and the marks."""

        def piece(s: Column) -> Column:
            kept = F.substr(block["part"], s["at"] - block["base"] + 1, s["start"] - s["at"])
            return F.when(s["start"] >= s["at"], F.concat(kept, F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")

        return F.array_join(F.transform(block["rows"], piece), "")

    last = F.greatest(F.get(until, n - 1), F.get(spans, n - 1)["end"])
    done = F.concat(F.array_join(F.transform(F.transform(F.sequence(F.lit(0), n - 1, step), cut), masked), ""), F.substr(text, last + 1))
    return docs_.withColumn(text_col, F.when(F.size(found) > 0, done).otherwise(text)).drop(found, ordered, ends, hidden)
