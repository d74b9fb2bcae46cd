"""Ordered ignore rules: of all rules that match a path the last one decides, a rule file deeper in the tree after those above.

Rule files and paths are rows; a path is looked up by equi joins on (directory of the rules, kind, key), so
only patterns with wildcards in odd places are tried one by one, and only below their own directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File names that hold rules, later ones before earlier ones; the longest line that can name a path.
RULE_FILES = ("exclude", ".gitignore", ".ignore")
LONGEST = 4096
# Named classes of characters, as both notations write them.
CLASSES = {"alnum": "Alnum", "alpha": "Alpha", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}
TOKEN = r"^(?:\*\*/)+|/(?:\*\*/)+|/\*\*$|\*+|\?|\[[!^]?+\]?+(?:\[:[a-z]+:\]|\\[\s\S]|[^\]\\])*\]|\\[\s\S]|[\s\S]"
MEMBER = r"\[:(?:" + "|".join(CLASSES) + r"):\]|(?:\\[\s\S]|[^\\])-(?:\\[\s\S]|[^\\])|\\[\s\S]|[\s\S]"
RANGE = r"^\\?([\s\S])-\\?([\s\S])$"
NEVER = "(?!)"


def _bytes(text: Column) -> Column:
    """A character for each byte: wildcards stand for bytes, as in git."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _code(char: Column) -> Column:
    return F.concat(F.lit(r"\x{"), F.hex(F.ascii(char)), F.lit("}"))


def _member(item: Column) -> Column:
    """One part of a bracket: a named class, a range (its first character where it is reversed) or a character."""
    low, high = F.regexp_extract(item, RANGE, 1), F.regexp_extract(item, RANGE, 2)
    out = F.when((low != "") & (high != ""), F.when(F.ascii(low) <= F.ascii(high), F.concat(_code(low), F.lit("-"), _code(high))).otherwise(_code(low)))
    for name, other in CLASSES.items():
        out = out.when(item == f"[:{name}:]", r"\p{" + other + "}")
    return out.otherwise(_code(F.right(item, F.lit(1))))


def _bracket(token: Column) -> Column:
    inner = F.regexp_extract(token, r"^\[[!^]?([\s\S]*)\]$", 1)
    members = F.array_join(F.transform(F.regexp_extract_all(inner, F.lit(MEMBER), F.lit(0)), _member), "")
    return F.concat(F.lit("(?!/)["), F.when(token.rlike(r"^\[[!^]"), "^").otherwise(""), members, F.lit("]"))


def _token(t: Column) -> Column:
    return (
        F.when(t.rlike(r"^(\*\*/)+$"), "(?:.*/)?")
        .when(t.rlike(r"^/(\*\*/)+$"), "/(?:.*/)?")
        .when(t == "/**", "/.+")
        .when(t.rlike(r"^\*+$"), "[^/]*")
        .when(t == "?", "[^/]")
        .when(t.isin("[", "\\"), NEVER)
        .when(t.startswith("[") & (F.length(t) > 1), _bracket(t))
        .otherwise(F.when(t == "/", "/").otherwise(_code(F.right(t, F.lit(1)))))
    )


def glob(pattern: Column) -> Column:
    """The regular expression of a wildcard pattern whose stars stay within one name, but for ``**`` between slashes."""
    body = F.array_join(F.transform(F.regexp_extract_all(pattern, F.lit(TOKEN), F.lit(0)), _token), "")
    return F.concat(F.lit("(?s)^"), F.when(pattern.rlike(r"^\*\*+$"), ".*").otherwise(body), F.lit("$"))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """A column computed once: through a generator, as plain projections are merged and repeat what they share."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def rules(files: DataFrame) -> DataFrame:
    """Rules of (path, text) rule files: ``base`` (directory), ``rank`` (the greatest decides), ``how``, ``key``, ``shape``, ``keeps``, ``folders``, ``anchored``.

    Null texts, comments, empty lines and lines longer than any path have no rule.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    priority = F.lit(-1)
    for k, n in enumerate(RULE_FILES):
        priority = F.when(name == n, k).otherwise(priority)
    base = F.regexp_replace("path", r"/?[^/]*$", "")
    depth = F.when(base == "", 0).otherwise(F.size(F.split(base, "/")))
    rows = files.filter("text is not null").select(base.alias("base"), priority.alias("p"), depth.alias("d"), F.posexplode(F.split("text", "\r?\n", -1)).alias("line", "raw"))
    rows = rows.filter((F.col("p") >= 0) & (F.length("raw") <= LONGEST) & ~F.col("raw").startswith("#"))
    # Spaces at the end go, but for one that a backslash quotes.
    head = F.regexp_replace("raw", " +$", "")
    quoted = (F.length(F.regexp_extract(head, r"(\\*)$", 1)) % 2 == 1) & F.col("raw").endswith(" ")
    rows = _once(rows, "text", F.when(quoted, F.concat(head, F.lit(" "))).otherwise(head))
    rows = _once(rows.withColumn("keeps", F.col("text").startswith("!")), "body", F.regexp_replace("text", "^!", ""))
    rows = _once(rows.withColumn("folders", F.col("body").endswith("/")), "inner", F.regexp_replace(F.regexp_replace("body", "/$", ""), r"^/?(\*\*/)+(?=[^/]+$)", ""))
    rows = _once(rows.withColumn("anchored", F.col("inner").contains("/")).drop("text"), "text", F.regexp_replace("inner", "^/", "")).filter("text <> ''")
    literal = ~F.col("text").rlike(r"[*?\[\\]")
    how = F.when(literal, F.when(F.col("anchored"), "path").otherwise("name")).when(F.col("text").rlike(r"^\*\.[^.*?\[\\/]+$") & ~F.col("anchored"), "ending").otherwise("glob")
    rows = _once(rows, "how", how)
    how = F.col("how")
    key = F.when(how == "ending", F.substring_index("text", ".", -1)).when(how == "glob", "").otherwise(F.col("text"))
    rows = rows.select("base", F.struct("p", "d", "line").alias("rank"), "how", key.alias("key"), F.when(how == "glob", F.col("text")).alias("glob"), "keeps", "folders", "anchored")
    # Each pattern is turned into an expression once.
    shapes = rows.filter("glob is not null").select("glob").distinct().withColumn("shape", glob(_bytes(F.col("glob"))))
    return rows.join(shapes, "glob", "left").drop("glob")


def excluded(paths: DataFrame, given: DataFrame) -> DataFrame:
    """The distinct ``path`` values (files, relative to the root) that the rules exclude, themselves or by a directory above.

    Each file and directory is judged once; nothing below an excluded directory comes back.
    Null and empty paths are not excluded; without rules nothing is.
    """
    files = paths.select("path").filter("path <> ''").distinct()
    parts = F.split("path", "/")
    count = F.size(parts)
    steps = files.select("path", parts.alias("parts"), F.explode(F.sequence(F.lit(1), count)).alias("n"))
    above = steps.select("path", F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/").alias("entry"), (F.col("n") < F.size("parts")).alias("folder"))
    split = F.split("entry", "/")
    places = above.select("entry", "folder").distinct().select("entry", "folder", split.alias("parts"), F.explode(F.sequence(F.lit(0), F.size(split) - 1)).alias("j"))
    base = F.when(F.col("j") == 0, "").otherwise(F.array_join(F.slice("parts", F.lit(1), F.col("j")), "/"))
    rest = F.array_join(F.slice("parts", F.col("j") + 1, F.size("parts") - F.col("j")), "/")
    name = F.element_at("parts", -1)
    places = places.select("entry", "folder", base.alias("base"), rest.alias("rest"), name.alias("name")).join(given.select("base").distinct(), "base", "left_semi")
    keys = F.array(
        F.struct(F.lit("name").alias("how"), F.col("name").alias("key")),
        F.struct(F.lit("path").alias("how"), F.col("rest").alias("key")),
        F.struct(F.lit("ending").alias("how"), F.when(F.col("name").contains("."), F.substring_index("name", ".", -1)).alias("key")),
        F.struct(F.lit("glob").alias("how"), F.lit("").alias("key")),
    )
    asked = places.select("*", F.inline(keys))
    hit = asked.join(given, ["base", "how", "key"]).filter(F.col("folder") | ~F.col("folders"))
    hit = hit.filter((F.col("how") != "glob") | F.regexp_like(_bytes(F.when(F.col("anchored"), F.col("rest")).otherwise(F.col("name"))), F.col("shape")))
    last = hit.groupBy("entry", "folder").agg(F.max(F.struct("rank", "keeps")).alias("b")).filter("not b.keeps").select("entry", "folder")
    return above.join(last, ["entry", "folder"], "left_semi").select("path").distinct()
