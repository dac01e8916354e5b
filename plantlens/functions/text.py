"""Text expressions: folding, tokens, markers, families, stars, truncation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantlens.functions.vocab import FAMILIES, FAMILY_WORDS, FOLD_CLASSIFIER, FOLD_SIMILARITY, STOPWORDS


def _text(c) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))


def fold(c, table: tuple[str, str] = FOLD_SIMILARITY) -> Column:
    """Lower case without the usual French accents; missing text is empty."""
    return F.translate(F.lower(_text(c)), *table)


def tokens(c) -> Column:
    """Words of the folded text: letters and digits, two or more, no stop words; repeats stay."""
    words = F.regexp_extract_all(fold(c), F.lit(r"[a-z0-9]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def grams(c) -> Column:
    """Lower-cased words of two or more characters followed by their neighbouring pairs."""
    words = F.regexp_extract_all(F.lower(_text(c)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return words


def pairs_of(words: str) -> Column:
    """Neighbouring words joined by a blank."""
    n = F.size(words)
    left = F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0)))
    right = F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.when(n >= 2, F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(
        F.array().cast("array<string>")
    )


def found_markers(c, markers: Sequence[str]) -> Column:
    """Markers contained in the folded text, in list order."""
    folded = c if isinstance(c, Column) else fold(c, FOLD_CLASSIFIER)
    hits = [F.when(F.contains(folded, F.lit(m)), F.lit(m)) for m in markers]
    return F.array_compact(F.array(*hits))


def family_pattern(family: str) -> str:
    """One regular expression per family; a word ends where a letter, digit or _ does not follow."""
    body = "|".join(FAMILY_WORDS[family])
    return r"(?<![\p{L}\p{N}_])(?:" + body + r")(?![\p{L}\p{N}_])"


def families_of(c) -> Column:
    """Families a cause text belongs to (any number of them)."""
    lowered = F.lower(_text(c))
    return F.array_compact(F.array(*[F.when(lowered.rlike(family_pattern(f)), F.lit(f)) for f in FAMILIES]))


def stars(confidence) -> Column:
    """Five-star rating of a confidence in 0..1."""
    c = confidence if isinstance(confidence, Column) else F.col(confidence)
    full = F.greatest(F.lit(0), F.least(F.lit(5), F.bround(c * 5, 0).cast("int")))
    return F.concat(F.repeat(F.lit("★"), full), F.repeat(F.lit("☆"), 5 - full))


def shorten(c, limit: int = 140) -> Column:
    """Text of at most ``limit`` characters, the last three being dots when it was cut."""
    t = _text(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 3), F.lit("...")))


def plain_number(c) -> Column:
    """Shortest decimal text of a double: plain digits from 1e-4 up to 1e16, an exponent outside."""
    c = c if isinstance(c, Column) else F.col(c)
    text, size = c.cast("string"), F.abs(c)
    digits = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    mantissa, power = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""), F.substring_index(text, "E", -1).try_cast("int")
    sign = F.when(power < 0, "-").otherwise("+")
    powered = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    long = F.concat(F.substring_index(text, "E", 1), F.lit("e"), sign, F.abs(power).cast("string"))
    powered = F.when(F.abs(power) > 99, F.regexp_replace(long, r"\.0e", "e")).otherwise(powered)
    return F.when(~text.contains("E"), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(powered)


def case_text(defect_type: str, context: str, parameters: str, causes: str) -> Column:
    """A case as one text: type, context, ``k=v`` and ``branch: a, b`` joined by `` | ``."""
    params = F.transform(
        F.map_entries(F.coalesce(F.col(parameters), F.create_map().cast("map<string,double>"))),
        lambda e: F.concat(e["key"], F.lit("="), plain_number(e["value"])),
    )
    branches = F.transform(
        F.map_entries(F.coalesce(F.col(causes), F.create_map().cast("map<string,array<string>>"))),
        lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ", ")),
    )
    head = F.array(F.nullif(F.col(defect_type), F.lit("")), F.nullif(F.col(context), F.lit("")))
    return F.array_join(F.array_compact(F.concat(head, params, branches)), " | ")


def enriched_context(context: str, traces: str) -> Column:
    """Context followed by the model trace lines, when there are any."""
    lines = F.concat_ws("\n", F.col(traces))
    return F.when(
        F.size(traces) > 0, F.trim(F.concat(_text(context), F.lit("\n--- IA V2 ---\n"), lines))
    ).otherwise(_text(context))


def trace_line(family, cause, confidence) -> Column:
    return F.format_string("[IA %s] top1=%s (%d%%)", family, cause, F.bround(confidence * 100, 0).cast("long"))
