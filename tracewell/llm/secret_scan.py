"""Operator 1, secret scans: patterns and sliding-window entropy, natively.

Everything is one projection of built-in functions over the scan.

* Patterned kinds (assign, access, hex).  Positions come from splitting the
  text at the pattern: gaps and matches alternate, and prefix sums of their
  lengths give the offsets.
* Kind `entropy`.  Candidates are maximal runs of base-64 letters of at least
  `WINDOW` characters.  A window slides over a candidate; a fold keeps the
  counts of the letters, packed in 5 bits each, and the sum of c*log2(c), both
  changed only for the letter that enters and the one that leaves.  A candidate counts if the best
  window's entropy reaches the limit of its character class (hex, lower-case
  with digits, mixed); windows that touch a placeholder word do not count.  The
  allow-list drops candidates without both letters and digits, UUIDs, and those
  paths and identifiers of which each segment is short, a number, words, or low
  in window entropy itself.  Base spans always stay; a candidate is what an
  access or hex span leaves of its run, and one that overlaps an assignment adds
  nothing.

No pattern repeats a group without a bound, on which the engine would recurse;
overlaps and cuts go through sorted scans, so a text of many spans takes about
linear time.

Defined cases: null and empty texts have no spans.  Texts are taken whole.
Repeated rows are judged alike; an empty table gives no rows.  Other columns
pass through; an input column named `out` (secrets) is replaced, and a
column of another case of that name too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import fresh, let

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Letters run on to the end of their run, so a shorter one cannot match later in it.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Both; where they meet, the access key is taken first.
BASE = f"{ACCESS}|{HEX}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Class, its pattern, and the least entropy (bits a character) of a window.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("lower", r"^[0-9a-z_=-]+$", 3.6), ("mixed", r".", 3.8))
ALLOWED = (
    r"^[^0-9]*$|^[^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
)
#: Windows that touch one of these do not count; those beside it do.
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0000|1234567"
#: Paths and identifiers, their separators, and what a segment of them usually is: short, a number, or words with a short number.
STRUCTURED = r"/[^/]*/|^[a-z]+[_-][a-z0-9_-]+$"
SEPARATOR = r"[/_-]"
USUAL = r"^(?:.{0,8}|[0-9]+|[A-Z]+[0-9]{0,4}|[A-Z]?[a-z]+(?:[A-Z][a-z]{2,}){0,6}[0-9]{0,4})=*$"


def prefixes(x: Column, op=lambda a, b: a + b, block: int = 256) -> Column:
    """Exclusive running sums (or other op, from 0) of an array of ints, in blocks against quadratic cost."""

    def fold(a: Column) -> Column:
        zero = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a"))
        return F.aggregate(a, zero, lambda acc, v: F.struct(op(acc["s"], v).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / F.lit(block)).cast("int") - 1, F.lit(0))), lambda b: F.slice(x, b * block + 1, F.lit(block)))

    def shifted(folds: Column) -> Column:
        offsets = fold(F.transform(folds, lambda f: f["s"]))["a"]
        return F.flatten(F.zip_with(F.transform(folds, lambda f: f["a"]), offsets, lambda a, o: F.transform(a, lambda v: op(v, o))))

    return let(F.transform(blocks, lambda b: fold(b)), shifted)


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of a pattern's matches; code points, end exclusive."""
    kind = "array<struct<start:int,end:int,match:string>>"

    def place(m: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        steps = F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda g, x: g + F.length(x))
        starts = F.zip_with(let(steps, lambda x: prefixes(x)), gaps, lambda s, g: s + g)
        return F.zip_with(F.slice(starts, 1, F.size(m)), m, lambda s, x: F.struct(s.alias("start"), (s + F.length(x)).alias("end"), x.alias("match"))).cast(kind)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, place(m)).otherwise(F.array().cast(kind)))


def window_entropy(word: Column, width: int = WINDOW) -> Column:
    """The highest Shannon entropy of a window of `width` letters (31 at most) of a word."""
    term = F.array(*[F.lit(0.0)] + [F.lit(c * math.log2(c)) for c in range(1, width + 2)])
    each = 12  # counts of 5 bits in a long
    one = F.array(*[F.lit(1 << 5 * k).cast("long") for k in range(each)])
    packs = -(-len(ALPHABET) // each)

    def fold(letters: Column) -> Column:
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), packs).alias("c"), F.lit(0.0).alias("s"), F.lit(float("inf")).alias("best"))

        def count(acc: Column, x: Column) -> Column:
            return F.call_function("shiftright", acc["c"][x["pack"]], x["at"] * 5).bitwiseAND(31).cast("int")

        def step(acc: Column, i: Column) -> Column:
            def moved(enters: Column, leaves: Column) -> Column:
                gained = let(count(acc, enters), lambda c: term[c + 1] - term[c])
                lost = F.when(leaves.isNotNull(), let(count(acc, leaves), lambda c: term[c - 1] - term[c])).otherwise(F.lit(0.0))
                counts = F.transform(
                    acc["c"],
                    lambda x, k: x + F.when(k == enters["pack"], one[enters["at"]]).otherwise(F.lit(0).cast("long")) - F.when(k == leaves["pack"], one[leaves["at"]]).otherwise(F.lit(0).cast("long")),
                )
                s = acc["s"] + gained + lost
                return F.when(enters == leaves, F.struct(acc["c"].alias("c"), acc["s"].alias("s"))).otherwise(F.struct(counts.alias("c"), s.alias("s")))

            after = moved(letters[i], F.when(i >= width, letters[F.greatest(i - width, F.lit(0))]))
            return let(after, lambda x: F.struct(x["c"].alias("c"), x["s"].alias("s"), F.when(i >= width - 1, F.least(acc["best"], x["s"])).otherwise(acc["best"]).alias("best")))

        return F.aggregate(F.sequence(F.lit(0), F.size(letters) - 1), start, step, lambda acc: F.lit(math.log2(width)) - acc["best"] / width)

    number = F.filter(F.transform(F.split(word, ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1), lambda k: k >= 0)
    return let(F.transform(number, lambda k: F.struct(F.floor(k / each).cast("int").alias("pack"), F.pmod(k, F.lit(each)).cast("int").alias("at"))), fold)


def _apart(candidates: Column, taken: Column) -> Column:
    """Candidates (start, end, match) that overlap none of the spans taken; both are sorted and disjoint in themselves."""

    def swept(events: Column) -> Column:
        reach = prefixes(F.transform(events, lambda e: F.when(e["c"].isNull(), e["end"]).otherwise(F.lit(0))), F.greatest)
        kept = F.zip_with(events, reach, lambda e, r: F.when(e["c"].isNotNull() & (r <= e["start"]), e["c"]))
        return F.filter(kept, lambda c: c.isNotNull())

    def event(x: Column, at: Column, kind: int, c: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), c.alias("c"))

    none = F.lit(None).cast("struct<start:int,end:int,match:string>")
    # a candidate stands at its end, a taken span at its start: what stands before it begins before its end
    both = F.concat(F.transform(candidates, lambda c: event(c, c["end"], 0, c)), F.transform(taken, lambda a: event(a, a["start"], 1, none)))
    return F.when((F.size(candidates) > 0) & (F.size(taken) > 0), let(F.sort_array(both), swept)).otherwise(candidates)


def _suspicious(c: Column) -> Column:
    word = c["match"]
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | F.rlike(word, F.lit(pattern))
    limit = F.lit(None).cast("double")
    for _, pattern, least in reversed(CLASSES):
        limit = F.when(F.rlike(word, F.lit(pattern)), F.lit(least)).otherwise(limit)
    cold = lambda part: (F.length(part) >= WINDOW) & (window_entropy(part) < limit)
    hot = F.exists(F.split(word, PLACEHOLDER), lambda part: (F.length(part) >= WINDOW) & (window_entropy(part) >= limit))
    usual = F.rlike(word, F.lit(STRUCTURED)) & F.forall(F.split(word, SEPARATOR), lambda part: F.rlike(part, F.lit(USUAL)) | cold(part))
    return F.when(allowed, F.lit(False)).when(~hot, F.lit(False)).otherwise(~usual)


def _blanked(text: Column) -> Column:
    """The text with its access and hex spans as blanks, so that what stands beside them in a run is a candidate of its own."""
    gaps, hits = F.split(text, BASE, -1), F.regexp_extract_all(text, F.lit(BASE), F.lit(0))
    return F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(F.repeat(F.lit(" "), F.length(h)), F.lit("")))), "")


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Add the array `out` of spans (start, kind number, end), by start, then kind, to docs.

    One projection after another, each of plain expressions over the one before.
    """
    own, assigned, runs, beside = (fresh(docs, f"__{x}") for x in ("own", "assigned", "runs", "beside"))
    rest = [c for c in docs.columns if c.lower() != out.lower()]

    def numbered(found: Column, k: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))

    def within(pattern: str, k: int) -> Column:  # access and hex lie in a run
        return F.when(F.size(runs) > 0, numbered(located(F.col(own), pattern), k)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))

    found = docs.select(*rest, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(own))
    found = found.withColumns({assigned: F.filter(located(F.col(own), ASSIGN), lambda x: F.length(F.regexp_extract(x["match"], "^" + ASSIGN, 2)) >= 6), runs: located(F.col(own), CANDIDATE)})
    cut = F.exists(runs, lambda c: F.rlike(c["match"], F.lit(BASE)))
    found = found.withColumn(beside, F.when(cut, located(_blanked(F.col(own)), CANDIDATE)).otherwise(F.col(runs)))
    found = found.withColumn(beside, F.filter(_apart(F.col(beside), F.col(assigned)), _suspicious))
    found = found.withColumn(out, F.sort_array(F.concat(numbered(F.col(assigned), 0), within(ACCESS, 1), within(HEX, 2), numbered(F.col(beside), 3))))
    return found.select(*rest, out)


def _cut(blocks: Column, a: Column, b: Column, block: int) -> Column:
    """The text between two places; blocks has it in pieces, as substring counts from the text's first letter."""
    first, last = F.floor(a / block).cast("int"), F.floor(b / block).cast("int")
    head = F.substring(blocks[first], a - first * block + 1, F.lit(block))
    tail = F.coalesce(F.substring(F.get(blocks, last), F.lit(1), b - last * block), F.lit(""))
    return F.when(first == last, F.substring(blocks[first], a - first * block + 1, b - a)).otherwise(F.concat(head, F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), tail))


def mask(text: Column, found: Column, mark: str = "[SECRET]", block: int = 4096) -> Column:
    """The text with each span (overlapping ones together) replaced by mark; found is sorted by start."""
    n = F.length(text)

    def out(blocks: Column, before: Column) -> Column:
        # before: how far the spans ahead of each reach
        kept = F.zip_with(found, before, lambda s, at: F.when(s["start"] >= at, F.concat(_cut(blocks, at, s["start"], block), F.lit(mark))).otherwise(F.lit("")))
        end = F.array_max(F.transform(found, lambda s: s["end"]))
        return F.concat(F.array_join(kept, ""), F.when(end < n, _cut(blocks, end, n, block)).otherwise(F.lit("")))

    pieces = F.transform(F.sequence(F.lit(0), F.floor(n / block).cast("int")), lambda k: F.substring(text, k * block + 1, F.lit(block)))
    reach = prefixes(F.transform(found, lambda s: s["end"]), F.greatest)
    return F.when(F.size(found) > 0, let(pieces, lambda x: let(reach, lambda r: out(x, r)))).otherwise(text)
