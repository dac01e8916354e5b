"""Quality rules as weak supervision.

Every rule looks at a few counts of a text and votes good, bad, or not at all.  No rule decides alone: expectation
maximisation over all documents estimates how often each rule is right about good and about bad documents (without
any labels), and a document's verdict is the posterior probability that it is good.  Documents with the same votes are
one row for the estimation, so it works on a table of at most ``3 ** len(RULES)`` vote patterns and their counts,
whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import Words, keyed, stored, text_groups

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # hundredths of the words
ROUNDS = 200
LEAST_POSTERIOR = 0.5
# What the estimates start from, and as how many documents that counts: the share of good documents, and how often a rule
# votes bad on a good document, on one with its own fault, and on one with another fault.
START_GOOD, START_FALSE, START_OWN, START_OTHER, PRIOR_WEIGHT = 0.8, 0.05, 0.9, 0.2, 10.0
# a rule is never taken to be surer than this on good documents, nor blinder than this to its own fault
LEAST_FALSE, LEAST_OWN = 0.01, 0.5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_ends", "n_distinct", "n_letter_words")


def _flags(values: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(values)] = 1
    return out


_SYMBOL = _flags(SYMBOLS)
_CAPITAL = _flags(bytes(range(65, 91)))
# code points are counted at their first byte; any beyond ASCII counts as a letter
_FIRST = 1 - _flags(bytes(range(0x80, 0xC0)))
_LETTER = _flags(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC0, 256)))
_SPACE = _flags(b" \t\n\x0b\x0c\r")
_END = _flags(b".!?").astype(bool)


def repeated_words(ids: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Number of words of each text in windows of three words that the text holds twice or more."""
    n = np.zeros(docs, np.int64)
    if len(ids) < 4:
        return n
    key = ids
    for nth in (ids[1:], ids[2:]):  # windows are numbered anew after each word, so that no key overflows
        key = np.unique(key[: len(nth)] * (int(ids.max()) + 1) + nth, return_inverse=True)[1]
    inside = doc[:-2] == doc[2:]
    _, which, count = np.unique((doc[:-2] * (int(key.max()) + 1) + key)[inside], return_inverse=True, return_counts=True)
    first = np.flatnonzero(inside)[count[which] > 1]
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[first + k] = True
    return np.bincount(doc[covered], minlength=docs)


def text_measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text of a group; see ``MEASURES``."""
    words = Words(data, offsets)
    docs = len(words.count)
    doc = words.doc

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags[data])])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    raw = data.tobytes()
    numbers: dict[bytes, int] = {}
    ids, dup, lines = [], np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    for i in range(docs):
        text = raw[offsets[i] : offsets[i + 1]]
        ids += [numbers.setdefault(w, len(numbers)) for w in text.split()]
        held = [line for line in text.split(b"\n") if line.strip()]
        lines[i], dup[i] = len(held), len(held) - len(set(held))
    ids = np.array(ids, np.int64)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    distinct = np.unique(doc * max(1, len(numbers)) + ids) // max(1, len(numbers))
    return {
        "n_words": words.count, "word_chars": total(_FIRST * (1 - _SPACE)), "n_symbols": total(_SYMBOL), "n_dup_lines": dup,
        "n_repeat_words": repeated_words(ids, doc, docs), "n_lines": lines, "n_capitals": total(_CAPITAL), "n_letters": total(_LETTER),
        "n_ends": np.bincount(doc[_END[data[words.end - 1]]], minlength=docs) if len(ids) else np.zeros(docs, np.int64), "n_distinct": np.bincount(distinct, minlength=docs),
        "n_letter_words": np.bincount(doc[letters[words.end] > letters[words.start]], minlength=docs),
    }


def _measure_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in text_groups(batch):
            found = text_measures(data, offsets)
            ids = [batch.column(c)[part] for c in ("k1", "k2", "doc_id")]
            yield pa.RecordBatch.from_arrays([*ids, *[pa.array(found[m].astype(np.int64)) for m in MEASURES]], names=["k1", "k2", "doc_id", *MEASURES])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k1, k2, doc_id`` and ``MEASURES`` of every row, over whole texts; nothing is shuffled."""
    return keyed(docs, id_col, text_col).mapInArrow(_measure_task, "k1 long, k2 long, doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


@dataclass(frozen=True)
class Rule:
    """A vote on the share of ``part`` in ``whole``: bad outside ``[low, high]``, good inside ``[good_low, good_high]``, else none.

    There is no vote on texts with fewer than ``least`` of ``whole``.
    """

    name: str
    part: str
    whole: str
    good_low: float
    good_high: float
    low: float
    high: float
    least: int = 1

    def vote(self) -> Column:
        share = F.col(self.part) / F.col(self.whole)
        votes = F.when((share < self.low) | (share > self.high), 0).when(share.between(self.good_low, self.good_high), 2).otherwise(1)
        return F.when(F.col(self.whole) >= self.least, votes).otherwise(1)


RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.02, 0.0, 0.1),
    Rule("repeated windows", "n_repeat_words", "n_words", 0.0, 0.1, 0.0, 0.3, 20),
    Rule("repeated lines", "n_dup_lines", "n_lines", 0.0, 0.1, 0.0, 0.3, 3),
    Rule("capitals", "n_capitals", "n_letters", 0.0, 0.1, 0.0, 0.3, 20),
    Rule("letters", "n_letters", "word_chars", 0.9, 1.0, 0.75, 1.0, 20),
    Rule("words with letters", "n_letter_words", "n_words", 0.95, 1.0, 0.8, 1.0, 10),
    Rule("word length", "word_chars", "n_words", 4.0, 7.0, 2.5, 12.0, 10),
    Rule("distinct words", "n_distinct", "n_words", 0.5, 1.0, 0.2, 1.0, 20),
    Rule("sentence ends", "n_ends", "n_words", 0.02, 0.25, 0.005, 0.5, 50),
)


def vote_pattern(rules: tuple[Rule, ...] = RULES) -> Column:
    """The votes as digits to base three: 0 bad, 1 none, 2 good."""
    code = F.lit(0).cast("long")
    for j, rule in enumerate(rules):
        code = code + rule.vote().cast("long") * 3**j
    return code


def pattern_votes(patterns: np.ndarray, n_rules: int) -> np.ndarray:
    """Votes -1, 0, 1 of each pattern and rule."""
    return patterns[:, None] // 3 ** np.arange(n_rules) % 3 - 1


def estimate(votes: np.ndarray, count: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(posterior, share, bad_rate)`` by expectation maximisation over vote patterns and their counts.

    A document is good (class 0) or has one main kind of fault, that of rule j (class j + 1).  ``share[c]`` is the share of
    class c, ``bad_rate[c, j]`` how often rule j, when it votes, votes bad in class c: its false alarms on good documents, its
    accuracy on bad ones.  With one class for all faults the commonest bundle of rules that agree would be taken for the
    fault, and rules that see another one for liars.  Within a class rules vote independently, and whether they vote doesn't
    depend on the class.  The start counts as a prior; the two limits keep a lone vote of a rule that nothing bears out from
    deciding, and keep each class to the fault it is named after.  ``posterior`` is the probability of class 0.
    """
    yes, no = (votes > 0).astype(float), (votes < 0).astype(float)
    n_rules = votes.shape[1]
    own = np.eye(n_rules + 1, n_rules, -1, bool)
    start_rate = np.where(own, START_OWN, START_OTHER)
    start_rate[0] = START_FALSE
    start_share = np.array([START_GOOD, *[(1 - START_GOOD) / n_rules] * n_rules])
    least = np.where(own, LEAST_OWN, 1e-6)
    least[0] = LEAST_FALSE
    rate, share = start_rate, start_share
    belongs = np.zeros((len(votes), n_rules + 1))
    for _ in range(rounds):
        log = np.log(share) + no @ np.log(rate).T + yes @ np.log(1 - rate).T
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        before, belongs = belongs, weight / weight.sum(axis=1, keepdims=True)
        held = belongs * count[:, None]
        share = (held.sum(axis=0) + PRIOR_WEIGHT * start_share) / (count.sum() + PRIOR_WEIGHT)
        rate = (held.T @ no + PRIOR_WEIGHT * start_rate) / (held.T @ (yes + no) + PRIOR_WEIGHT)
        rate = np.clip(rate, least, 1 - 1e-6)
        if np.abs(belongs - before).max(initial=0) < 1e-12:
            break
    return belongs[:, 0], share, rate


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``k1, k2, doc_id``, the measures, ``base_failed``, ``posterior`` and ``kept`` of every row.

    ``base_failed``: fewer than ``LEAST_WORDS`` words, or more than ``MOST_REPEATED`` hundredths of them repeated.  ``kept``: not so, and
    a posterior of at least ``LEAST_POSTERIOR``.  All rows take part in the estimation.  A null or empty text has no words and fails; rows that repeat an
    id or a text are rows of their own; an empty table gives an empty result.  Other columns are never read.
    """
    spark = docs.sparkSession
    code = vote_pattern(rules)
    rows = stored(measured(docs, id_col, text_col).withColumn("pattern", code), "rule-votes")
    seen = rows.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3 ** len(rules) rows
    patterns = np.array([r["pattern"] for r in seen], np.int64)
    posterior, _, _ = estimate(pattern_votes(patterns, len(rules)), np.array([r["count"] for r in seen], np.float64))
    table = spark.createDataFrame([(int(p), float(x)) for p, x in zip(patterns, posterior, strict=True)], "pattern long, posterior double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.join(F.broadcast(table), "pattern").select(
        "k1", "k2", "doc_id", *MEASURES, failed.alias("base_failed"), "posterior", (~failed & (F.col("posterior") >= LEAST_POSTERIOR)).alias("kept"))
