"""Path, name and text functions as Spark columns; everything runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Module names that belong to the runtime.
BUILTINS = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module",
    "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)
#: The runtime's modules below one of these names.
BUILTIN_PARTS = (
    "assert/strict", "dns/promises", "fs/promises", "inspector/promises", "path/posix", "path/win32", "readline/promises", "stream/consumers", "stream/promises", "stream/web", "timers/promises", "util/types",
)
#: Fixed value: the endings that a module's name leaves out.
MODULE_ENDING = r"(\.d)?\.(tsx?|mts|cts|jsx?|mjs|cjs)$"


def normalize_path(p: Column) -> Column:
    """Separators made '/', empty and '.' parts dropped, '..' resolved; null if the path leaves its root."""
    parts = F.filter(F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    out = F.aggregate(
        parts,
        F.array(F.lit("")),
        lambda acc, x: F.when(acc.isNull(), acc).when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(F.filter(out, lambda x: x != ""), "/")


def join_path(folder: Column, specifier: Column) -> Column:
    return normalize_path(F.concat_ws("/", folder, specifier))


def dirname(p: Column) -> Column:
    return F.regexp_extract(p, "^(.*)/[^/]*$", 1)


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def extension(p: Column) -> Column:
    return F.regexp_extract(basename(p), r"(\.[^.]+)$", 1)


def ancestors(p: Column) -> Column:
    """Every parent folder, outermost first; empty for a file at the root."""
    parts = F.split(p, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def package_name(s: Column) -> Column:
    """Scope and name, or name, of the package a specifier is from."""
    return F.when(s.startswith("@"), F.substring_index(s, "/", 2)).otherwise(F.substring_index(s, "/", 1))


def package_key(s: Column) -> Column:
    """The package a specifier is from; runtime modules get the prefix node:."""
    name = package_name(F.regexp_replace(s, "^node:", ""))
    return F.when(s.startswith("node:") | name.isin(*BUILTINS), F.concat(F.lit("node:"), name)).otherwise(name)


def is_subpath(s: Column) -> Column:
    """Whether a specifier names more than its package."""
    bare = F.regexp_replace(s, "^node:", "")
    return bare != package_name(bare)


def slug(s: Column) -> Column:
    """A name of a-z, 0-9 and '-' that starts with a letter; 'bucket' if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9-]+", "-"), "^[^a-z]+", ""), "-+$", "")
    return F.when(out == "", "bucket").otherwise(out)


def default_export_name(p: Column) -> Column:
    """A name for a file's default export: words of its name, or of its folder's for an index file, joined; each after the first capitalised."""
    parts = F.split(F.regexp_replace(p, MODULE_ENDING, ""), "/")
    stem = F.when((F.element_at(parts, -1) == "index") & (F.size(parts) > 1), F.try_element_at(parts, F.lit(-2))).otherwise(F.element_at(parts, -1))
    words = F.filter(F.split(stem, "[^A-Za-z0-9_$]+"), lambda x: x != "")
    out = F.array_join(F.transform(words, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2147483647)))), "")
    return F.when(out == "", "defaultExport").when(out.rlike("^[0-9]"), F.concat(F.lit("_"), out)).otherwise(out)


def reexport_specifier(public: Column, target: Column) -> Column:
    """The relative specifier by which a public file names a target."""
    folders, to = F.slice(F.split(public, "/"), F.lit(1), F.size(F.split(public, "/")) - 1), F.split(F.regexp_replace(target, MODULE_ENDING, ""), "/")
    most = F.least(F.size(folders), F.size(to) - 1)
    same = F.zip_with(F.slice(folders, F.lit(1), most), F.slice(to, F.lit(1), most), lambda a, b: a == b)
    first = F.array_position(same, False).cast("int")
    shared = F.when(first > 0, first - 1).otherwise(most)
    up, rest = F.size(folders) - shared, F.array_join(F.slice(to, shared + 1, F.size(to)), "/")
    return F.when(up == 0, F.concat(F.lit("./"), rest)).otherwise(F.concat(F.array_join(F.array_repeat(F.lit("../"), up), ""), rest))


def version_status(v: Column, major: int, minor: int) -> Column:
    """supported, newer or invalid, of a '<major>.<minor>' string against the version served."""
    a, b = (F.regexp_extract(v, r"^(\d+)\.(\d+)$", k).try_cast("int") for k in (1, 2))
    return F.when(v.isNull() | a.isNull() | (a < major), "invalid").when((a > major) | (b > minor), "newer").otherwise("supported")


def truncate_middle(s: Column, most: int) -> Column:
    keep = max(most - 3, 2)
    left, right = (keep + 1) // 2, keep // 2
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, left), F.lit("..."), F.substring(s, -right, right)))


def join_and(a: Column) -> Column:
    n = F.size(a)
    return F.when(n < 2, F.array_join(a, "")).otherwise(F.concat(F.array_join(F.slice(a, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(a, -1)))


def escape_data(s: Column) -> Column:
    out = F.replace(s, F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(out, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def match_score(kind: Column, label: Column, query: str) -> Column:
    """0 equal (0.5 but for case), 1 prefix of the label or of a file's name, 2 at the start of a part after one of / - _ ., 3 anywhere, null not at all."""
    key, q = F.lower(label), query.strip().lower()
    prefix = key.startswith(q) | ((kind == "file") & F.substring_index(key, "/", -1).startswith(q))
    inner = F.exists(F.sequence(F.lit(2), F.greatest(F.length(key), F.lit(2))), lambda i: F.substring(key, i - 1, F.lit(1)).isin("/", "-", "_", ".") & (F.substring(key, i, F.lit(len(q))) == q))
    return F.when(~key.contains(q) | F.lit(q == ""), None).when(key == q, F.when(label == query.strip(), 0.0).otherwise(0.5)).when(prefix, 1.0).when(inner, 2.0).otherwise(3.0)
