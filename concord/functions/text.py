"""Texts of messages, labels and versions as Spark columns; everything runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that give no reason. The pattern of a word is fixed too.
FILLER = ("a", "an", "and", "the", "it", "on", "to", "for", "uses", "use", "needs", "need", "calls", "call", "imports", "import", "depends", "depend")
WORD = r"[\p{L}\p{N}@:/._-]+"
#: Words, beside those of FILLER, that say nothing about what a group does.
PURPOSE_FILLER = ("its", "of", "all", "some", "other", "various", "misc", "does", "do", "job", "jobs", "stuff", "things", "thing", "handles", "handle", "code", "logic", "work", "works", "everything", "related")
#: Fixed value: the form of a version.
VERSION = r"^(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\z"
#: Control characters and the separators of lines and paragraphs.
UNSEEN = r"[\p{Cc}  ]"


def one_line(s: Column) -> Column:
    r"""Control characters and separators written out: \n, \r, \t, else \u and four digits."""

    def written(c: Column) -> Column:
        known = F.when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t")
        return known.when(c.rlike(UNSEEN), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))).otherwise(c)

    return F.when(s.rlike(UNSEEN), F.array_join(F.transform(F.split(s, ""), written), "")).otherwise(s)


def config_path(at: Column) -> Column:
    """at: array of struct(name, k), k for a place in a list -> buckets.log, ignore[0], buckets["Odd.Name"]."""

    def part(x: Column, i: Column) -> Column:
        plain = x["name"].rlike(r"^[A-Za-z_$][\w$-]*\z")
        return (
            F.when(x["k"].isNotNull(), F.concat(F.lit("["), x["k"].cast("string"), F.lit("]")))
            .when(plain & (i == 0), x["name"])
            .when(plain, F.concat(F.lit("."), x["name"]))
            .otherwise(F.to_json(F.array(x["name"])))
        )

    return F.array_join(F.transform(at, part), "")


def filler_only(text: Column, names: tuple[str, ...] = ()) -> Column:
    """Whether a purpose holds only names of groups and words that say nothing; true for one without words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.forall(words, lambda w: w.isin(*FILLER, *PURPOSE_FILLER) | F.regexp_replace(w, "[.:]+$", "").isin(*names))


def version_key(v: Column) -> Column:
    """A key that orders versions as semver does, a release after its prereleases; null, which sorts first, for other texts. Numbers of up to 38 digits."""
    number = lambda k: F.regexp_extract(v, VERSION, k).try_cast("decimal(38,0)")
    pre = F.regexp_extract(v, VERSION, 4)
    parts = F.transform(
        F.split(pre, r"\.", -1),
        lambda x: F.struct((~x.rlike(r"^\d+\z")).alias("word"), x.try_cast("decimal(38,0)").alias("n"), F.when(~x.rlike(r"^\d+\z"), x).alias("t")),
    )
    parts = F.transform(parts, lambda x: F.struct(x["word"].alias("word"), F.when(~x["word"], x["n"]).alias("n"), x["t"].alias("t")))
    return F.when(v.rlike(VERSION), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (pre == "").alias("release"), parts.alias("pre")))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a is older than, as old as or newer than b; a text that is no version is older than any."""
    x, y = version_key(a), version_key(b)
    return F.when(x.eqNullSafe(y), 0).when(y.isNull(), 1).when(x.isNull(), -1).when(x < y, -1).otherwise(1)


def short_stamp(s: Column, digits: int = 16) -> Column:
    return F.left(F.sha2(s, 256), F.lit(digits))


def _spaced(s: Column) -> Column:
    return F.regexp_replace(s, r"[\r\n  ]+", " ")


def mermaid_label(s: Column) -> Column:
    out = _spaced(s)
    for mark, entity in (("#", "#35;"), ('"', "#quot;"), ("<", "#lt;"), (">", "#gt;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def dot_string(s: Column) -> Column:
    out = F.replace(F.replace(_spaced(s), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), out, F.lit('"'))


def counted(n: Column, one: str, more: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {more}"))


def cell_text(state: Column, imports: Column) -> Column:
    return F.when(state == "unused", "0").otherwise(imports.cast("string"))


def cell_title(src: Column, dst: Column, state: Column, imports: Column) -> Column:
    n = counted(imports, "import", "imports")
    what = F.when(state == "used", n).when(state == "unused", "declared, never imported").otherwise(F.concat(F.lit("undeclared, "), n))
    return F.concat(src, F.lit(" -> "), dst, F.lit(": "), what)


def rounded(x: Column) -> Column:
    """A number of one decimal as written in messages: without '.0'."""
    return F.regexp_replace(F.round(x, 1).cast("decimal(30,1)").cast("string"), r"\.0$", "")
