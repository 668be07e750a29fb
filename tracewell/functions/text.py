"""Scalar functions on names, addresses, paths, urls, JSON text and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hex_address(value: Column) -> Column:
    """0x and lower-case digits without leading zeros, of a hex text; null if it is none."""
    digits = F.lower(F.regexp_extract(F.trim(value), r"^0[xX]([0-9a-fA-F]+)$", 1))
    return F.when(digits != "", F.concat(F.lit("0x"), F.regexp_replace(digits, "^0+(?=.)", "")))


def address_number(value: Column) -> Column:
    """The number of a canonical hex address, for addresses up to 64 bits."""
    return F.conv(F.substring(value, 3, 16), 16, 10).cast("decimal(20,0)")


def is_auto_name(name: Column) -> Column:
    """Whether a symbol is named after its address."""
    return F.rlike(name, F.lit(r"^(sub|loc|unk|fcn|FUN)_?[0-9A-Fa-f]+$"))


def symbol(name: Column) -> Column:
    """A symbol without leading underscores and argument bytes (@8), in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "^_+", ""), "@[0-9]+$", ""))


def path(raw: Column) -> Column:
    """A relative path with slashes, without scheme, host and query; null if it leaves its root or is empty."""
    own = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", ""), r"\\", "/")
    parts = F.filter(F.split(own, "/"), lambda x: ~x.isin("", "."))
    return F.when(~F.array_contains(parts, "..") & (F.size(parts) > 0), F.array_join(parts, "/"))


def path_suffixes(whole: Column) -> Column:
    """All suffixes of a path, the longest first."""
    parts = F.split(whole, "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "/"))


def extension(whole: Column) -> Column:
    """The lower-case extension with its dot, or empty."""
    return F.lower(F.regexp_extract(whole, r"[^/](\.[^./]+)$", 1))


def by_extension(whole: Column, kinds: dict[str, str], rest: str | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), extension(whole))
    return F.coalesce(found, F.lit(rest)) if rest is not None else found


def sanitized_url(url: Column) -> Column:
    """A url without credentials and fragment, and with its query values hidden."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"^([a-z][a-z0-9+.-]*://)[^/?#@]*@", "$1")
    return F.regexp_replace(bare, r"([?&][^=&#]*)=[^&#]*", "$1=<redacted>")


def redacted(value: Column, secrets: list[tuple[str, str]]) -> Column:
    """Text with each (pattern, alias) replaced in turn by <secret:alias>."""
    for pattern, alias in secrets:
        value = F.regexp_replace(value, pattern, f"<secret:{alias}>")
    return value


def normalized_output(value: Column, root: str) -> Column:
    """Process output without what changes from run to run: the root path, then process ids, then ports."""
    own = F.replace(value, F.lit(root), F.lit("<root>"))
    own = F.regexp_replace(own, r"\bpid[ =]\d+", "pid=<pid>")
    return F.regexp_replace(own, r"(?<=[:=])\d{2,5}\b", "<port>")


def is_canonical_base64(value: Column) -> Column:
    """Whether decoding and encoding again gives the same text."""
    ok = F.rlike(value, F.lit(r"^[A-Za-z0-9+/]*={0,2}$")) & (F.length(value) % 4 == 0)
    return F.coalesce(ok & (F.base64(F.try_to_binary(value, F.lit("base64"))) == value), F.lit(False))


def version_at_least(version: Column, major: int, minor: int) -> Column:
    """Whether a dotted version, with or without v, is of this family or a later minor one; null if it is no version."""
    part = lambda i: F.regexp_extract(version, r"^v?(\d+)\.(\d+)\.\d+", i).try_cast("int")
    return F.when(part(1).isNotNull(), (part(1) > major) | ((part(1) == major) & (part(2) >= minor)))


def property_of_selector(selector: Column) -> Column:
    """The property that an accessor reads or sets: setName: and isName give name."""
    setter = F.regexp_extract(selector, r"^set([A-Z]\w*):$", 1)
    getter = F.regexp_extract(selector, r"^is([A-Z]\w*)$", 1)
    own = F.when(setter != "", setter).when(getter != "", getter)
    return F.when(own.isNotNull(), F.concat(F.lower(F.substring(own, 1, 1)), F.substring(own, 2, F.length(own)))).when(F.rlike(selector, F.lit(r"^[a-z]\w*$")), selector)


def elapsed(ms: Column, bucket: int) -> Column:
    """ms, rounded down to a multiple of bucket, in whole numbers."""
    return (ms - F.pmod(ms, F.lit(bucket))).cast("long")


def epoch_micros(rows: DataFrame, c: str) -> Column:
    """Microseconds since 1970; a time without zone is taken as it stands, whatever the session's zone."""
    t = F.col(c)
    if rows.schema[c].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(t)
    minutes = F.unix_date(t.cast("date")).cast("long") * 1440 + F.hour(t) * 60 + F.minute(t)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def canonical_json(value: Column) -> Column:
    """JSON text in its canonical form: sorted keys, no blanks, shortest numbers; null if it is no JSON or not finite."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def canonical(texts):
        return texts.map(canonical_text, na_action="ignore")

    return canonical(value)


def canonical_text(text: str) -> str | None:
    import json
    from decimal import Decimal

    def number(x: float) -> str:
        if x == int(x) and abs(x) < 1e21:
            return str(int(Decimal(repr(x))))
        digits, _, exponent = repr(x).partition("e")
        if not exponent:
            return digits
        power = int(exponent)
        if -7 < power < 0:  # written out down to 1e-6
            sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
            return f"{sign}0.{'0' * (-power - 1)}{digits.replace('.', '')}"
        return f"{digits.removesuffix('.0')}e{'+' if power > 0 else '-'}{abs(power)}"

    def told(x) -> str:
        if isinstance(x, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{told(x[k])}" for k in sorted(x, key=lambda k: k.encode("utf-16-be"))) + "}"
        if isinstance(x, list):
            return "[" + ",".join(map(told, x)) + "]"
        if isinstance(x, bool) or x is None:
            return {True: "true", False: "false", None: "null"}[x]
        return number(float(x)) if isinstance(x, int | float) else json.dumps(x, ensure_ascii=False)

    def refuse(name: str):
        raise ValueError(name)

    try:
        return told(json.loads(text, parse_constant=refuse))
    except (ValueError, OverflowError):
        return None


def folded(value: Column) -> Column:
    """Compatibility form (NFKC) in lower case, for searches."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def fold(texts):
        import unicodedata

        return texts.map(lambda x: unicodedata.normalize("NFKC", x).lower(), na_action="ignore")

    return fold(value)


def code_unit_key(value: Column) -> Column:
    """A binary key that sorts texts by UTF-16 code units: signs above U+FFFF come before those from U+E000."""
    return F.encode(value, "UTF-16BE")


def in_locale(value: Column, locale: str = "en") -> Column:
    """A text that sorts and compares by the collation of a locale: signs, then letters, accents and case last."""
    return F.collate(value, locale)


def json_within(value: Column, depth: int, length: int) -> Column:
    """Whether JSON text is short enough and its brackets, strings left out, nest no deeper."""
    bare = F.regexp_replace(F.regexp_replace(value, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    deep = F.aggregate(
        F.filter(F.split(bare, ""), lambda c: c != ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")),
        lambda acc, c: F.struct((acc["at"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("at"), F.greatest(acc["most"], acc["at"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most")),
        lambda acc: acc["most"],
    )
    return (F.length(value) <= length) & (deep <= depth)


def edits(left: list[str], right: list[str], most: int = 10_000) -> tuple[int, int] | None:
    """Lines added and removed by a shortest edit script; None beyond `most` edits."""
    n, m = len(left), len(right)
    ends = {1: 0}
    for d in range(min(n + m, most) + 1):
        for k in range(-d, d + 1, 2):
            x = ends[k + 1] if k == -d or (k != d and ends[k - 1] < ends[k + 1]) else ends[k - 1] + 1
            while x < n and x - k < m and left[x] == right[x - k]:
                x += 1
            ends[k] = x
            if x >= n and x - k >= m:
                return (d + m - n) // 2, (d + n - m) // 2
    return None


def line_changes(left: Column, right: Column) -> Column:
    """added,removed lines between two texts as a text, null if either is null or they are too far apart."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def changes(a, b):
        found = (None if x is None or y is None else edits(x.split("\n"), y.split("\n")) for x, y in zip(a, b, strict=True))
        return a.__class__([None if f is None else f"{f[0]},{f[1]}" for f in found], dtype=object)

    return changes(left, right)
