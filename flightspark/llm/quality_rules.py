"""Rule ledger: every rule is evaluated once per document and leaves one failure bit next to the measurements.

Policies are versioned sets of bits. Applying one, or asking what it would have kept without one of its rules, reads the
ledger only; texts are not touched again.

Defined results: a null or empty text has no words and zero in every measurement; a null doc_id is kept as it is; repeated
rows are judged one by one, each on its own text; further columns never enter a measurement.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightspark.llm.bytes_kit import Rolling, U64, Words, covered, free_name, mix, per_row, slices

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_exclaim")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Rules by bit. Each reads measurements only, so a row of the ledger can be judged anew without its text.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeat_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("dup_lines", "n_dup_lines >= 2 AND 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("capitals", "n_upper > n_lower"),
    ("exclaims", "100 * n_exclaim > 30 * n_words"),
)
BASE = ("few_words", "repeat_words")
#: Policies by version; a new version is added, none is changed.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "prose-1": tuple(name for name, _ in RULES),
    "prose-2": (*BASE, "symbols", "dup_lines", "long_words", "capitals", "exclaims"),
}
DEFAULT_POLICY = "prose-2"


def mask(rules: Iterable[str]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in set(rules))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.zeros(len(s), bool)
    out[order] = same[:-1] | same[1:]
    return out


def _measure(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    rows = len(off) - 1
    roll = Rolling(data + U64(1))
    w = Words(data, off)
    words = w.count
    chars = per_row(w.ink & ((data & 0xC0) != 0x80), off)
    symbols = per_row(SYMBOLS[data], off)
    salt = mix(np.arange(1, rows + 1, dtype=U64))

    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([off[:-1], breaks + 1]))
    row = np.searchsorted(off[1:], starts, "right")
    at_end = np.concatenate([off[1:], breaks])
    ends = np.sort(at_end)
    inked = np.zeros(len(data) + 1, np.int64)
    np.cumsum(w.ink, out=inked[1:])
    # A line ending the slice's row pairs with the row's end; both lists have one entry per line, in order.
    good = (row < rows) & (ends >= starts)
    starts, ends, row = starts[good], ends[good], row[good]
    inky = inked[ends] > inked[starts]
    line = mix(roll.of(starts[inky], ends[inky]) ^ salt[row[inky]])
    lines = np.bincount(row[inky], minlength=rows)
    _, one = np.unique(line, return_index=True)
    dup = lines - np.bincount(row[inky][one], minlength=rows)

    tri = Rolling(w.hashes(roll)).grams(3)
    ok = w.whole(3)
    hit = np.zeros(len(tri), bool)
    hit[ok] = _repeated(mix(tri[ok] ^ salt[w.row[: len(tri)][ok]]))
    repeat = per_row(covered(hit, 3, len(w)), w.first) if len(tri) else np.zeros(rows, np.int64)

    upper = per_row((data >= 65) & (data <= 90), off)
    lower = per_row((data >= 97) & (data <= 122), off)
    return [words, chars, symbols, dup, repeat, lines, upper, lower, per_row(data == 33, off)]


def _measure_all(text: pa.Array) -> pa.Array:
    parts = [_measure(d, o) for _, _, d, o in slices(text)]
    cols = [np.concatenate(c).astype(np.int64) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c) for c in cols], list(MEASURES))


measures = F.arrow_udf(_measure_all, T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))


def failure_bits(get) -> Column:
    """All failure bits from a struct of measurements; `get` names the struct column."""
    bits = F.lit(0).cast("long")
    for i, (_, rule) in enumerate(RULES):
        for m in MEASURES:
            rule = rule.replace(m, f"{get}.{m}")
        bits = bits + F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0))
    return bits


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the measurements, bits): one row per row of `docs`."""
    m = docs.select(F.col(key), measures(F.col(text)).alias("_m"))
    return m.select(key, *[F.col(f"_m.{c}").alias(c) for c in MEASURES], failure_bits("_m").alias("bits"))


def passes(bits: Column, policy: str = DEFAULT_POLICY) -> Column:
    return bits.bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def apply_policy(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Adds `kept` to a ledger."""
    return rows.withColumn("kept", passes(F.col("bits"), policy))


def ablations(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """(rule, failed, only_this, kept_without): what each rule of a policy rejects, alone and in company.

    The ledger is first counted by bit pattern, of which there are at most two to the number of rules.
    """
    full = mask(POLICIES[policy])
    patterns = rows.groupBy(F.col("bits").bitwiseAND(F.lit(full)).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    out = []
    for i, (name, _) in enumerate(RULES):
        if name in POLICIES[policy]:
            bit = 1 << i
            out.append(F.struct(
                F.lit(name).alias("rule"),
                F.coalesce(F.sum(F.when(F.col("p").bitwiseAND(F.lit(bit)) != 0, F.col("n"))), F.lit(0)).alias("failed"),
                F.coalesce(F.sum(F.when(F.col("p") == bit, F.col("n"))), F.lit(0)).alias("only_this"),
                F.coalesce(F.sum(F.when(F.col("p").bitwiseAND(F.lit(full & ~bit)) == 0, F.col("n"))), F.lit(0)).alias("kept_without")))
    return patterns.agg(F.array(*out).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def reject(docs: DataFrame, policy: str = DEFAULT_POLICY, text: str = "text") -> DataFrame:
    """`docs` without the documents that the policy rejects; columns as they came."""
    name = free_name(docs.columns, "_m")
    return docs.withColumn(name, measures(F.col(text))).filter(passes(failure_bits(name), policy)).drop(name)
