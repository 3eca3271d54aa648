"""Text expressions: normal forms, error rates, index helpers and output parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width marks and the half-width ones they count as.
WIDE_MARKS = "（）【】｛｝，：；！？。"
NARROW_MARKS = "()[]{},:;!?."


def no_spaces(text: Column) -> Column:
    """Text without any Unicode white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def narrow_marks(text: Column) -> Column:
    """Full-width punctuation as half-width; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), WIDE_MARKS, NARROW_MARKS)


def plain_form(text: Column) -> Column:
    """The wider normal form of edit analysis: narrow marks, one kind of dash, '->' for an arrow, no spaces."""
    t = F.translate(text, WIDE_MARKS + "—–－　", NARROW_MARKS + "--- ")
    return F.trim(F.replace(F.replace(t, F.lit("→"), F.lit("->")), F.lit(" "), F.lit("")))


def distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def near_first(a: Column, b: Column, near: int = 3) -> Column:
    """The edit distance: equal texts cost nothing, a band of `near` around the diagonal is tried next,
    and only pairs farther apart need the whole table."""
    band = F.levenshtein(a, b, near)
    return F.when(a == b, 0).when(band >= 0, band).otherwise(F.levenshtein(a, b))


def ratio(part: Column, whole: Column, empty: Column | float = 0.0) -> Column:
    """part / whole, or `empty` where there is no whole."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double")).otherwise(empty)


def cer_spaces(pred: Column, ref: Column) -> Column:
    """Error rate without white space; an empty truth counts 0 for an empty reading and 1 for another."""
    p, r = no_spaces(pred), no_spaces(ref)
    return ratio(F.levenshtein(p, r), F.length(r), F.when(F.length(p) == 0, 0.0).otherwise(1.0))


def cer_marks(pred: Column, ref: Column) -> Column:
    """Error rate with narrow marks; an empty truth counts 0."""
    p, r = narrow_marks(pred), narrow_marks(ref)
    return ratio(F.levenshtein(p, r), F.length(r))


def length_change(a: Column, b: Column) -> Column:
    """Relative change of length from a to b; 0 where a is empty."""
    return ratio(F.abs(F.length(b) - F.length(a)), F.length(a))


def tolerant_double(value: Column, default: float | None = None) -> Column:
    """A string as a double; null, empty and unparsable ones give the default."""
    return F.coalesce(value.try_cast("double"), F.lit(default).cast("double"))


def budget_tag(budget: Column) -> Column:
    """A budget in whole percent, of two digits at least."""
    p = F.bround(budget * 100).cast("int").cast("string")
    return F.when(F.length(p) < 2, F.lpad(p, 2, "0")).otherwise(p)


# -- indexes -------------------------------------------------------------------------------------


def shown_index(i: Column) -> Column:
    """0-based index as shown to people, '?' for a negative one."""
    return F.when(i < 0, "?").otherwise((i + 1).cast("string"))


def checked_index(i: Column, text: Column, allow_negative: bool = True) -> Column:
    """(valid, index): the index itself, -1 if it is negative and may be, else clamped into the text."""
    n = F.length(F.coalesce(text, F.lit("")))
    inside = (i >= 0) & (i < n)
    unknown = (i < 0) & F.lit(allow_negative)
    clamped = F.greatest(F.lit(0), F.least(i, n - 1))
    return F.struct((inside | unknown).alias("valid"), F.when(inside, i).when(unknown, -1).when(n == 0, -1).otherwise(clamped).cast("int").alias("index"))


def char_at(text: Column, i: Column, default: str = "?") -> Column:
    return F.when((i >= 0) & (i < F.length(text)), F.substring(text, i + 1, F.lit(1))).otherwise(default)


def swap_char(text: Column, i: Column, pairs: dict[str, str]) -> Column:
    """The text with the character at i replaced by its confusable partner, if it has one."""
    c = char_at(text, i, "")
    to = F.translate(c, "".join(pairs), "".join(pairs.values()))
    return F.when((c != "") & (to != c), F.concat(F.left(text, i), to, F.substring(text, i + 2, F.length(text)))).otherwise(text)


# -- output parsers ------------------------------------------------------------------------------


def first_answer(raw: Column, markers: list[str], quotes: str = "\"'`") -> Column:
    """What follows the last of `markers` (if any), its first line, without quotes around it."""
    text = F.coalesce(raw, F.lit(""))
    for m in markers:
        text = F.when(F.contains(text, F.lit(m)), F.element_at(F.split(text, F.regexp_replace(F.lit(m), r"([\[\](){}.*+?^$|\\])", r"\\$1")), -1)).otherwise(text)
    return F.btrim(F.trim(F.split_part(F.trim(text), F.lit("\n"), F.lit(1))), F.lit(quotes))


def defended_answer(raw: Column, fallback: Column, markers: list[str], leaks: list[str], least_share: float | None = None, script: str = "[一-鿿]") -> Column:
    """An answer that is not an analysis: think blocks go; an answer that is empty, repeats a prompt
    fragment of `leaks`, or has too small a share of the wanted script gives the fallback."""
    clean = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?s)<think>.*?</think>", "")
    answer = first_answer(clean, markers)
    bad = answer == ""
    for leak in leaks:
        bad = bad | F.contains(answer, F.lit(leak))
    if least_share is not None:
        bad = bad | (F.regexp_count(answer, F.lit(script)) < F.length(answer) * least_share)
    return F.when(bad, fallback).otherwise(answer)


def between(text: Column, left: str = "【", right: str = "】") -> Column:
    """The first bracketed part of a text."""
    return F.regexp_extract(text, f"{left}\\s*(.+?)\\s*{right}", 1)


def unbracketed(text: Column, fallback: Column, pairs: str = "【】[]()（）", depth: int = 8) -> Column:
    """A text without the bracket pairs around it, at most `depth` of them; the fallback if that equals
    the fallback without its own."""

    def once(t: Column) -> Column:
        t = F.trim(t)
        for a, b in zip(pairs[::2], pairs[1::2], strict=True):
            t = F.when((F.length(t) >= 2) & F.startswith(t, F.lit(a)) & F.endswith(t, F.lit(b)), F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)
        return t

    strip = lambda t: F.aggregate(F.sequence(F.lit(1), F.lit(depth)), t, lambda acc, _: once(acc))
    inner = strip(text)
    return F.when(inner == strip(fallback), fallback).otherwise(inner)


def reversed_runs(text: Column, kept: str = "[a-zA-Z0-9 :*./%+-]") -> Column:
    """Right-to-left order: characters are reversed, but runs of `kept` ones stay as they read."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s){kept}+|."), F.lit(0))
    return F.array_join(F.reverse(pieces), "")


def deletion_label(a: Column, gt: Column) -> Column:
    """1 where the truth is longer and only misses characters at one end of the reading."""
    return ((F.length(gt) > F.length(a)) & (F.endswith(gt, a) | F.startswith(gt, a))).cast("int")


SECRET_FORMS = {
    "key_assignment": r"(?i)(api[_-]?key|token|secret|passw(or)?d)\s*[:=]\s*.?[A-Za-z0-9_/+=-]{16,}",
    "home_path": r"(/home/|/Users/|[A-Z]:\\\\)[A-Za-z0-9._-]+",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}


def secret_forms(text: Column) -> Column:
    """Names of the secret or path forms that a text has."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in SECRET_FORMS.items()]))
