"""Tokens of JavaScript texts, fingerprints that outlive renaming, and exports; all in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# possessive repeats only: no text makes the matcher recurse
_COMMENT = r"//[^\n]*+|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
_STRING = r"\"[^\"\\\n]*+(?:\\[\s\S][^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
_NUMBER = r"[0-9][0-9A-Za-z_.]*+"
_NAME = r"[A-Za-z_$][\w$]*+"
_MARK = r"=>|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\.\.\.|\S"
# fixed values: reserved words of the language
_WORDS = (
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in "
    "instanceof let new null return static super switch this throw true try typeof undefined var void while with yield"
).split()


def tokens(source: Column) -> Column:
    """Texts of the tokens without comments; a slash is always a mark, never the start of a pattern."""
    every = F.regexp_extract_all(source, F.lit(f"({_COMMENT}|{_STRING}|{_NUMBER}|{_NAME}|{_MARK})"), F.lit(1))
    return F.filter(every, lambda t: ~(F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("/*"))))


def fingerprints(df: DataFrame, key: str, source: Column, literals: bool = True) -> DataFrame:
    """key, tokens, sha256: a digest of a script's structure in which own names are equal.

    Property names (after a dot, or before a colon at the start of an object's
    entry), reserved words and marks count; literals do if asked for.  A null
    script has no tokens and a null digest; an empty one the digest of nothing.
    """
    own = df.select(key, tokens(source).alias("__t"))
    at = lambda i: F.get("__t", i)

    def kept(t: Column, i: Column) -> Column:
        literal = F.rlike(t, F.lit("^[\"'`0-9]"))
        owned = at(i - 1).isin(".", "?.") | (at(i - 1).isin("{", ",") & (at(i + 1) == ":"))
        name = F.when(F.coalesce(owned, F.lit(False)), F.concat(F.lit("property "), t)).when(t.isin(_WORDS), t).otherwise("name")
        return F.when(literal, t if literals else F.when(F.rlike(t, F.lit("^[0-9]")), "number").otherwise("string")).when(F.rlike(t, F.lit("^[A-Za-z_$]")), name).otherwise(t)

    marks = F.transform("__t", kept)
    told = F.transform(marks, lambda m: F.concat(F.length(m).cast("string"), F.lit(":"), m))  # no two lists of tokens share a text
    return own.select(key, F.size("__t").cast("long").alias("tokens"), F.sha2(F.array_join(told, ""), 256).alias("sha256"))


def exports(df: DataFrame, key: str, source: Column) -> DataFrame:
    """key, name: names that a script exports, each once: assignments to exports or module.exports and their members,
    defined properties, keys of an exported object, and exported declarations; an export without a name is `default`."""
    own = df.select(key, tokens(source).alias("__t"))
    near = lambda t, i: F.struct(i.alias("i"), t.alias("t"), *[F.get("__t", i + k).alias(f"{'b' if k < 0 else 'n'}{abs(k)}") for k in (-2, -1, 1, 2, 3, 4, 5, 6)])
    placed = own.select(key, F.explode(F.transform("__t", near)).alias("x")).select(key, "x.*")
    t, b2, b1, n1, n2, n3, n4, n5, n6 = map(F.col, ("t", "b2", "b1", "n1", "n2", "n3", "n4", "n5", "n6"))
    bare = lambda t: F.regexp_replace(t, "^[\"'](.*)[\"']$", "$1")
    named = lambda t: F.rlike(t, F.lit(r"^[A-Za-z_$]"))
    free = (t == "exports") & ((F.coalesce(b1, F.lit("")) != ".") | (b2 == "module"))  # of its own or of module
    found = (
        F.when(free & (n1 == ".") & (n3 == "=") & named(n2), n2)
        .when(free & (n1 == "[") & (n3 == "]") & (n4 == "=") & F.rlike(n2, F.lit("^[\"']")), bare(n2))
        .when(free & (n1 == "=") & (n2 != "{"), "default")
        .when((t == "defineProperty") & (b1 == ".") & (b2 == "Object") & (n1 == "(") & (n2 == "exports") & (n3 == ","), bare(n4))
        .when((t == "defineProperty") & (b1 == ".") & (b2 == "Object") & (n1 == "(") & (n2 == "module") & (n4 == "exports") & (n5 == ","), bare(n6))
        .when((t == "export") & (n1 == "default"), "default")
        .when((t == "export") & n1.isin("function", "class", "const", "let", "var") & named(n2), n2)
        .when((t == "export") & (n1 == "async") & (n2 == "function") & named(n3), n3)
    )
    # keys of an exported object: entries right inside its brace, which are at the depth that the brace opens
    w = Window.partitionBy(key).orderBy("i")
    opens = F.coalesce((t == "{") & (b1 == "=") & (b2 == "exports"), F.lit(False))
    turn = F.when(t.isin("{", "(", "["), 1).when(t.isin("}", ")", "]"), -1).otherwise(0)
    deep = placed.withColumns({"found": found, "opens": opens}).withColumn("depth", F.sum(turn).over(w))
    since = lambda c: F.last(F.when(F.col("opens"), F.col(c)), ignorenulls=True).over(w)
    own_brace = deep.withColumns({"start": since("i"), "base": since("depth")})
    ended = F.count_if((t == "}") & (F.col("depth") == F.col("base") - 1)).over(Window.partitionBy(key, "start").orderBy("i"))
    entry = (F.col("ended") == 0) & (F.col("depth") == F.col("base")) & b1.isin("{", ",") & n1.isin(":", ",", "}", "(") & F.rlike(t, F.lit("^[A-Za-z_$\"']"))
    told = own_brace.withColumn("ended", ended).select(key, F.explode(F.array_compact(F.array("found", F.when(entry, bare(t))))).alias("name"))
    return told.distinct()


def selected(candidates: DataFrame, wanted: DataFrame, module: str, name: str) -> DataFrame:
    """wanted with status, exact and near: which export a selector (module, name) means.

    candidates: module, name, one row for each export.  selected: exactly one
    fits; ambiguous: more do, and none is chosen; missing.  exact: how many fit;
    near: if none does, how many share the module or the name, else 0.
    """
    count = lambda by, out: candidates.groupBy(*by).agg(F.count("*").alias(out))
    told = wanted.join(count([module, name], "exact"), [module, name], "left").join(count([module], "__m"), module, "left").join(count([name], "__n"), name, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    state = F.when(n("exact") == 0, "missing").when(n("exact") == 1, "selected").otherwise("ambiguous")
    return told.select(*wanted.columns, state.alias("status"), n("exact").alias("exact"), F.when(n("exact") == 0, n("__m") + n("__n")).otherwise(0).alias("near"))
