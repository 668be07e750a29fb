"""Operator 10, quality rules: a threshold table compiled into one projection.

`measures` builds length, symbol, stop-word, repetition and line counts of a
text as native expressions; `compile_rules` turns a table of
(name, ratio, low, high) into one boolean column for each rule.  Spark runs
all of it in a single projection over the scan: no shuffle, no user function.

Defined cases: null and empty texts have no words, so all counts are 0 and
`base_failed` is true; ratios over 0 words are 0.  Very long texts are taken
whole; time is n log n in the words of a text.  Repeated rows are judged one
by one; an empty table gives no rows.  Extra columns pass through `judge`,
but one that is named like an output (with its prefix) is replaced; `prefix`
avoids that.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import ascii_lower, fresh, let, words

SYMBOLS = "[#*$%&|<>]"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    "the of and to in is that it for as with was on be at by this are or an from not "
    "der die und das den von zu mit ist des im dem nicht ein eine als auch auf "
    "le la les des et en du un une que est pour dans par sur au qui pas "
    "el los las de y que se del por con una su para es al lo como".split()
)


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= ratio <= high; None leaves a side open."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None


#: The thresholds; ratios are columns that `ratios` makes.
RULES = (
    Rule("mean_word_chars", "word_chars_per_word", 2.0, 15.0),
    Rule("symbols", "symbols_per_word", None, 0.3),
    Rule("dup_lines", "dup_lines_per_line", None, 0.5),
    Rule("repeats", "repeat_words_per_word", None, 0.5),
    Rule("stop_words", "stop_words_per_word", 0.01, None),
)


PLACE_BITS = 24


def _marked(hits: Column) -> Column:
    """How many words lie in the 3-word windows that begin at the places `hits` (null: none there)."""
    hit = F.filter(hits, lambda i: i.isNotNull())
    return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda i: F.array(i, i + 1, i + 2)))))


def _beside(s: Column, same) -> Column:
    """The places of sorted windows that are the same as a neighbour."""
    last = F.size(s) - 1
    return F.transform(s, lambda x, j: ((j > 0) & same(s[F.greatest(j - 1, F.lit(0))], x)) | ((j < last) & same(s[F.least(j + 1, last)], x)))


def _repeat_words(w: Column) -> Column:
    """Words that lie in 3-word windows found twice or more.

    Each window is a number: its hash, and its place in the last 24 bits.
    Sorted, equal windows are neighbours; where neighbours of one hash differ in
    their words, or a text has too many words for the places, its windows are
    sorted as strings instead.
    """
    n = F.size(w)
    begins = F.slice(w, 1, F.greatest(n - 2, F.lit(0)))
    place = F.lit((1 << PLACE_BITS) - 1).cast("long")
    numbers = F.transform(begins, lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]).bitwiseAND(~((1 << PLACE_BITS) - 1)).bitwiseOR(i.cast("long")))
    at = lambda x: x.bitwiseAND(place).cast("int")
    alike = lambda x, y: F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS)
    words_of = lambda i: F.struct(w[i], w[i + 1], w[i + 2])

    def of_strings(s: Column) -> Column:
        again = _beside(s, lambda x, y: x["k"] == y["k"])
        return _marked(F.zip_with(s, again, lambda x, hit: F.when(hit, x["i"])))

    strings = F.transform(begins, lambda x, i: F.struct(F.concat_ws(" ", x, w[i + 1], w[i + 2]).alias("k"), i.alias("i")))

    def of_numbers(s: Column) -> Column:
        pairs = F.zip_with(s, _beside(s, alike), lambda x, hit: F.when(hit, x))

        def told(hits: Column) -> Column:
            differ = F.exists(F.sequence(F.lit(1), F.size(hits) - 1), lambda j: alike(hits[j - 1], hits[j]) & (words_of(at(hits[j - 1])) != words_of(at(hits[j]))))
            return F.when(F.size(hits) == 0, F.lit(0)).when(differ, let(F.sort_array(strings), of_strings)).otherwise(_marked(F.transform(hits, at)))

        return let(F.filter(pairs, lambda x: x.isNotNull()), told)

    return F.when(n < 4, F.lit(0)).when(n < 1 << PLACE_BITS, let(F.sort_array(numbers), of_numbers)).otherwise(let(F.sort_array(strings), of_strings))


def _is_stop_word(word: Column, stop_words, cells: int = 256) -> Column:
    """Whether a word, in lower case, is in the list; looked up in a table by crc32."""
    table: list[list[str]] = [[] for _ in range(cells)]
    for x in sorted(set(stop_words)):
        table[zlib.crc32(x.encode()) % cells].append(x)
    rows = F.array(*[F.array(*map(F.lit, own)).cast("array<string>") for own in table])
    look = let(ascii_lower(word), lambda x: F.array_contains(rows[(F.crc32(x.cast("binary")) % cells).cast("int")], x))
    return F.when(F.length(word) <= max(map(len, stop_words), default=0), look).otherwise(False)


def measures(text: Column, stop_words=STOP_WORDS) -> Column:
    """Struct of the counts of a text."""

    def lines(t: Column) -> Column:
        return F.filter(F.split(t, "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.regexp_extract_all(text, F.lit(SYMBOLS), F.lit(0))).cast("long").alias("n_symbols"),
            let(lines(text), lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: _is_stop_word(x, stop_words))).cast("long").alias("n_stop_words"),
        )

    return let(words(text), of)


def ratios(m: Column) -> dict[str, Column]:
    def by(x: Column, n: Column) -> Column:
        return F.when(n > 0, x / n).otherwise(F.lit(0.0))

    n = m["n_words"]
    return {
        "word_chars_per_word": by(m["word_chars"], n),
        "symbols_per_word": by(m["n_symbols"], n),
        "dup_lines_per_line": by(m["lines"]["n"] - m["lines"]["d"], m["lines"]["n"]),
        "repeat_words_per_word": by(m["n_repeat_words"], n),
        "stop_words_per_word": by(m["n_stop_words"], n),
        "words": n.cast("double"),
    }


def compile_rules(rules, found: dict[str, Column]) -> dict[str, Column]:
    """One boolean column for each rule: true if the document passes it."""
    out = {}
    for r in rules:
        x, ok = found[r.ratio], F.lit(True)
        if r.low is not None:
            ok = ok & (x >= r.low)
        if r.high is not None:
            ok = ok & (x <= r.high)
        out[r.name] = ok
    return out


def judge(docs: DataFrame, text: str = "text", rules=RULES, min_words: int = 50, max_repeat_percent: int = 50, prefix: str = "") -> DataFrame:
    """Add the counts, base_failed, failed_rules (array) and kept to docs."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = fresh(docs, "__m")
    m = F.col(name)
    checks = compile_rules(rules, ratios(m))
    failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    base = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
    made = {
        "n_words": m["n_words"],
        "word_chars": m["word_chars"],
        "n_symbols": m["n_symbols"],
        "n_dup_lines": m["lines"]["n"] - m["lines"]["d"],
        "n_repeat_words": m["n_repeat_words"],
        "base_failed": base,
        "failed_rules": failed,
        "kept": ~base & (F.size(failed) == 0),
    }
    measured = docs.withColumn(name, measures(body))
    return measured.withColumns({prefix + k: v for k, v in made.items()}).drop(name)
