"""Names of languages, sources, files and sizes; number forms."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parts import ASTRAL

# Short names of languages.
LANGUAGE_ALIASES = {
    "js": "javascript", "ts": "typescript", "py": "python", "rb": "ruby", "sh": "shellscript", "bash": "shellscript",
    "zsh": "shellscript", "yml": "yaml", "md": "markdown",
}
# What each engine calls a family: (highlight.js, prism, sugar-high, starry-night); None where it has no grammar.
ENGINES = ("highlight.js", "prism.js", "sugar-high", "starry-night")
ENGINE_LANGUAGES = {
    "javascript": ("javascript", "javascript", "javascript", "source.js"),
    "python": ("python", "python", "python", "source.python"),
    "typescript": ("typescript", "typescript", "typescript", "source.ts"),
    "shell": ("bash", "bash", "shell", "source.shell"),
    "dockerfile": ("dockerfile", "docker", "dockerfile", "source.dockerfile"),
    "java": ("java", "java", "java", "source.java"),
    "cpp": ("cpp", "cpp", "cpp", "source.c++"),
    "c": ("c", "c", "c", "source.c"),
    "makefile": ("makefile", "makefile", None, "source.makefile"),
    "batchfile": ("dos", "batch", None, "source.batchfile"),
    "php": ("php", "php", "php", "text.html.php"),
    "csharp": ("csharp", "csharp", "csharp", "source.cs"),
    "powershell": ("powershell", "powershell", "powershell", "source.powershell"),
    "cmake": ("cmake", "cmake", None, "source.cmake"),
    "kotlin": ("kotlin", "kotlin", "kotlin", "source.kotlin"),
    "ruby": ("ruby", "ruby", "ruby", "source.ruby"),
    "swift": ("swift", "swift", "swift", "source.swift"),
    "go": ("go", "go", "go", "source.go"),
    "plpgsql": ("pgsql", "sql", "sql", "source.sql"),
    "rust": ("rust", "rust", "rust", "source.rust"),
    "objective-c": ("objectivec", "objectivec", None, "source.objc"),
    "lua": ("lua", "lua", "lua", "source.lua"),
    "dart": ("dart", "dart", None, "source.dart"),
    "procfile": ("bash", "bash", "shell", "source.procfile"),
    "assembly": ("x86asm", "nasm", None, "source.assembly"),
}
# Fixed value: the longest source that examples keep.
MOST_UNITS = 20_000


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain(*table.items()))), key)


def normal_language(name: Column) -> Column:
    return F.coalesce(lookup(LANGUAGE_ALIASES, F.lower(name)), name)


def engine_language(engine: str, family: Column, language: Column) -> Column:
    """What the engine calls the language; null if it has no grammar, so that all of its parts count as wrong."""
    known = lookup({k: v[ENGINES.index(engine)] for k, v in ENGINE_LANGUAGES.items() if v[ENGINES.index(engine)]}, family)
    if engine == "starry-night":
        return F.when(language == "tsx", "source.tsx").otherwise(known)
    if engine == "prism.js":
        return F.when(language.isin("tsx", "jsx"), language).otherwise(known)
    return known


def source_of_url(url: Column) -> Column:
    """struct(kind, source_name, revision, path) of a source URL: a repository's raw file, a package's file, or any other."""
    host = F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_extract(url, "^[a-z]+://[^/?#]*/([^?#]*)", 1)
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    git = r"^([^/]+/[^/]+)/([^/]+)/(.+)$"
    package = r"^((?:@|%40)[^/]+/[^/]+|[^@%/][^/]*)@([^@/]+)/(.*)$"
    one = lambda kind, *columns: F.struct(F.lit(kind).alias("kind"), *(c.alias(n) for c, n in zip(columns, ("source_name", "revision", "path"), strict=True)))
    found = lambda pattern, k: plain(F.regexp_extract(path, pattern, k))
    return (
        F.when((host == "raw.githubusercontent.com") & path.rlike(git), one("git", *(found(git, k) for k in (1, 2, 3))))
        .when((host == "unpkg.com") & path.rlike(package), one("npm", *(found(package, k) for k in (1, 2, 3))))
        .otherwise(one("url", host, F.lit("url"), plain(path)))
    )


def directory_name(name: Column, revision: Column) -> Column:
    return F.concat(F.replace(name, F.lit("/"), F.lit("__")), F.lit("@"), revision)


def truncated(text: Column, most: int = MOST_UNITS) -> Column:
    """The first ``most`` UTF-16 units; a character that the end would halve is left out."""
    # A mark before each character of two units makes characters count as units do.
    near = F.substring(text, 1, most)
    marked = F.regexp_replace(near, f"({ASTRAL})", "\uf8ff$1")
    halved = F.substring(marked, most, 2).rlike(f"^\uf8ff{ASTRAL}")
    cut = F.substring(marked, 1, F.when(halved, most - 1).otherwise(most))
    whole = F.octet_length(near) < F.char_length(near) + 3
    return F.when(whole, near).otherwise(F.regexp_replace(cut, f"\uf8ff({ASTRAL})", "$1"))


def pin_problem(kind: Column, license: Column, revision: Column, allowed: list[str]) -> Column:
    """Why a corpus source may not be used: its license, or a revision that is no full commit or exact version; else null."""
    exact = F.when(kind == "git", revision.rlike(r"^[\da-f]{40}$")).otherwise(revision.rlike(r"^\d+\.\d+\.\d+(?:[-+].*)?$"))
    return F.when(~F.coalesce(license.isin(*allowed), F.lit(False)), "license").when(~F.coalesce(exact, F.lit(False)), "revision")


def percent(share: Column) -> Column:
    return F.format_string("%.2f%%", share * 100)


def duration(seconds: Column) -> Column:
    whole = F.greatest(F.lit(0), F.bround(seconds).cast("long"))
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def size(n_bytes: Column) -> Column:
    return F.when(n_bytes == 0, "0KB").when(n_bytes >= 1 << 20, F.format_string("%.2fMB", n_bytes / float(1 << 20))).otherwise(F.format_string("%.1fKB", n_bytes / 1024.0))


def canonical_json(entries: Column) -> Column:
    """A map of strings as JSON with its keys in order, so equal maps have equal strings."""
    pair = lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(":"), F.to_json(F.array(e["value"])))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(entries)), pair), ","), F.lit("}"))


def overlap_share(a: Column, b: Column, c: Column, d: Column) -> Column:
    """How much of the shorter of [a, b) and [c, d) lies in the other."""
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c)) / F.least(b - a, d - c)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def gelu(x: Column) -> Column:
    """The tanh form."""
    return 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))


def root_mean_square(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(values))


def example_rows(text: Column) -> Column:
    """array<struct(id, name, language, url)> of the example entries in a source text."""
    entry = r"\{\s*id:\s*'([^']+)',\s*name:\s*'([^']+)',\s*language:\s*'([^']+)',\s*url:\s*'([^']+)',?\s*\}"
    field = lambda e, k: F.regexp_extract(e, entry, k)
    return F.transform(
        F.regexp_extract_all(text, F.lit(entry), F.lit(0)),
        lambda e: F.struct(*(field(e, k).alias(n) for k, n in enumerate(("id", "name", "language", "url"), 1))),
    )


def unread_examples(text: Column) -> Column:
    """How many entries name a URL but could not be read."""
    return F.regexp_count(text, F.lit(r"\burl:\s*'")) - F.size(example_rows(text))
