"""Quality rules: every rule is evaluated once into a ledger of bits and measurements; policies are masks over it."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import TO_SPACE, slices

#: Bit of each rule. A rule's bit in `failed` is set where the text fails it. Bits are never reused: ledgers outlive policies.
RULES = {
    "few_words": 0, "repeated_windows": 1, "word_length": 2, "symbols": 3, "duplicate_lines": 4, "few_letters": 5,
    "no_sentence": 6, "ellipsis_lines": 7, "one_word": 8, "bullet_lines": 9, "too_many_words": 10,
}


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a text is kept if it fails none of `rules`, and at most `tolerated` of `soft`."""

    version: int
    rules: tuple[str, ...]
    soft: tuple[str, ...] = ()
    tolerated: int = 0

    @staticmethod
    def mask(names: tuple[str, ...]) -> int:
        return sum(1 << RULES[n] for n in names)

    def keeps(self, failed):
        """Column: whether a text with these failure bits is kept."""
        hard = failed.bitwiseAND(F.lit(self.mask(self.rules))) == 0
        return hard & (F.bit_count(failed.bitwiseAND(F.lit(self.mask(self.soft)))) <= self.tolerated)


#: Version 1 holds the two base rules only; version 2 adds hard limits that clean prose stays far from.
POLICIES = {
    1: Policy(1, ("few_words", "repeated_windows")),
    2: Policy(2, ("few_words", "repeated_windows", "word_length", "symbols", "few_letters"), ("duplicate_lines", "no_sentence", "ellipsis_lines", "one_word", "bullet_lines"), 1),
}
CURRENT = 2
SYMBOLS = re.compile(r"[#*$%&|<>]")
END = re.compile(r"[.!?。！？।؟…:;]")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the bits of the rules that the text fails."""
    text = text or ""
    words = [w for w in text.translate(TO_SPACE).split(" ") if w]
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(SYMBOLS.findall(text))
    lines = [line for line in text.split("\n") if line.translate(TO_SPACE).strip(" ")]
    duplicate = len(lines) - len(set(lines))
    repeated = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        if len(seen) < len(windows):
            upto = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 3 - max(i, upto)
                    upto = i + 3
    failed = 0
    if n < 50:
        failed |= 1 << RULES["few_words"]
    if 100 * repeated > 50 * n:
        failed |= 1 << RULES["repeated_windows"]
    if n:
        letters = sum(map(str.isalpha, text))
        most = Counter(words).most_common(1)[0][1]
        failed |= (not 2 * n <= chars <= 15 * n) << RULES["word_length"]
        failed |= (10 * symbols > 3 * n) << RULES["symbols"]
        failed |= (2 * duplicate > len(lines)) << RULES["duplicate_lines"]
        failed |= (2 * letters < chars) << RULES["few_letters"]
        failed |= (END.search(text) is None) << RULES["no_sentence"]
        failed |= (10 * sum(x.rstrip().endswith(("...", "…")) for x in lines) > 3 * len(lines)) << RULES["ellipsis_lines"]
        failed |= (10 * most > 3 * n) << RULES["one_word"]
        failed |= (10 * sum(x.lstrip().startswith(("-", "*", "•", "‣", "▪")) for x in lines) > 9 * len(lines)) << RULES["bullet_lines"]
        failed |= (n > 1_000_000) << RULES["too_many_words"]
    return n, chars, symbols, duplicate, repeated, failed


def _ledger(batches):
    schema = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES), ("failed", pa.int64())])
    for batch in batches:
        for part in slices(batch, "text"):
            found = list(zip(*map(measure, part.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in found)], schema=schema)


def ledger(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, the measurements, and failed (long, a bit of RULES for each rule that it fails).

    A word is a run of anything but space and \\x09-\\x0D, as it is written. A null text is as an empty one: no words,
    so it fails few_words and no other rule. Equal rows give equal rows; ties can't arise. Rules hold for whole texts
    of any length, in one pass and with memory in proportion to one text. An empty table gives no rows. Other columns
    aren't read.
    """
    kinds = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", failed long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_ledger, kinds)


def verdicts(rows: DataFrame, policy: Policy | int = CURRENT) -> DataFrame:
    """The ledger with base_failed (a rule of policy 1 fails), kept (under `policy`, false if base_failed) and policy (its version)."""
    policy = POLICIES[policy] if isinstance(policy, int) else policy
    base = ~POLICIES[1].keeps(F.col("failed"))
    return rows.withColumns({"base_failed": base, "kept": ~base & policy.keeps(F.col("failed")), "policy": F.lit(policy.version)})


def ablations(rows: DataFrame, policy: Policy | int = CURRENT) -> DataFrame:
    """For each rule of the policy, hard ones first, then soft ones: fails (texts), alone (texts that would be kept without this rule only), words_alone.

    One bitwise aggregation over the ledger; texts aren't read again.
    """
    policy = POLICIES[policy] if isinstance(policy, int) else policy
    failed = F.col("failed")
    sums = {}
    for name in (*policy.rules, *policy.soft):
        without = Policy(policy.version, tuple(r for r in policy.rules if r != name), tuple(r for r in policy.soft if r != name), policy.tolerated)
        alone = without.keeps(failed) & ~policy.keeps(failed)
        sums[name] = F.struct(F.sum(F.shiftright(failed, RULES[name]).bitwiseAND(F.lit(1))).alias("fails"), F.sum(alone.cast("long")).alias("alone"), F.sum(F.when(alone, F.col("n_words")).otherwise(0)).alias("words_alone"))
    one = rows.agg(*[s.alias(name) for name, s in sums.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("s")) for n in sums])).alias("e")).select("e.rule", *[F.coalesce(f"e.s.{c}", F.lit(0)).cast("long").alias(c) for c in ("fails", "alone", "words_alone")])
