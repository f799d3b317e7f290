"""Documents, pages and files: classes, secrets, words, slices, Markdown and HTML."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import predicates as P

# File names and folders that hold credentials, and extensions that often do.
CREDENTIAL_DIRS, MAYBE_DIRS = (".ssh", ".gnupg", ".aws", ".gcloud"), ("secrets", ".secrets", "credentials")
CREDENTIAL_NAMES = (
    r"(?i)^\.(env|envrc)(\.|$)", r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$", r"(?i)(^|[^A-Za-z0-9])(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$",
    r"(?i)^secring(\.(gpg|pgp))?$", r"(?i)(\.netrc|\.pgpass|\.htpasswd|\.npmrc|\.pypirc|\.git-credentials|\.boto)$",
)
CREDENTIAL_WORD = r"(?i)(?<![a-zA-Z0-9])((credential|secret|passwd|password|private_key)s?|tokens?|service[._-]?account)(?![a-zA-Z])"
DATA_EXT = ("json", "yaml", "yml", "toml", "ini", "cfg", "conf", "config", "xml", "properties", "env", "txt", "tfvars")
PROSE_EXT = ("md", "markdown", "rst", "org", "adoc", "tex")
# Corpus sizes at which a scan warns.
WARN_WORDS, LARGE_WORDS, LARGE_FILES = 50_000, 500_000, 500
# Folders of tools and builds.
NOISE_DIRS = r"(^|/)(node_modules|\.git|\.venv|venv|env|__pycache__|\.tox|\.mypy_cache|\.pytest_cache|\.ruff_cache|build|dist|target|coverage|htmlcov|\.next|\.nuxt|site-packages)(/|$)"


def word_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")))


def is_sensitive(path: Column) -> Column:
    """A credential store's folder, a credential's file name, or a telling word that names the contents."""
    name, folders = P.basename(path), F.transform(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), F.lower)
    source = P.extension(path).isin(*P.CODE_EXT) & ~P.extension(path).isin(*DATA_EXT)
    held = F.exists(folders, lambda d: d.isin(*CREDENTIAL_DIRS)) | (F.exists(folders, lambda d: d.isin(*MAYBE_DIRS)) & ~source)
    template = F.lower(name).rlike(r"^\.(env|envrc)\..*\.?(example|sample|template|dist)$")
    named = F.lit(False)
    for rx in CREDENTIAL_NAMES:
        named = named | name.rlike(rx)
    stem = F.regexp_replace(F.regexp_replace(name, r"^\.+", ""), r"(?<=.)\.[^.]*$", "")
    note = P.extension(path).isin(*PROSE_EXT) & ~stem.rlike(f"^(?:{CREDENTIAL_WORD})$")
    words = F.size(F.filter(F.split(stem, r"[-_\s.]+"), lambda w: w != ""))
    telling = stem.rlike(CREDENTIAL_WORD + "$") | (stem.rlike(CREDENTIAL_WORD) & (words <= 2))
    return held | (named & ~template) | (telling & ~source & ~note)


def scan(files: DataFrame) -> DataFrame:
    """Files (path, content) with category, words and what is skipped."""
    return files.select(
        "path", P.classify_path(F.col("path"), F.col("content")).alias("category"), word_count(F.coalesce("content", F.lit(""))).alias("words"),
        is_sensitive(F.col("path")).alias("sensitive"), F.col("path").rlike(NOISE_DIRS).alias("noise"),
    )


def scan_summary(scanned: DataFrame) -> DataFrame:
    use = scanned.where("NOT sensitive AND NOT noise AND category IS NOT NULL")
    out = use.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("words"), F.lit(0)).alias("total_words"))
    return out.withColumns({"needs_graph": F.col("total_words") >= WARN_WORDS, "large": (F.col("total_words") > LARGE_WORDS) | (F.col("total_files") > LARGE_FILES)})


def glob_regex(pattern: str) -> tuple[str, bool, bool]:
    """(regex on the relative path, negated, folders only) of a line of an ignore file."""
    negated, p = pattern.startswith("!"), pattern.removeprefix("!").rstrip()
    folder, p = p.endswith("/"), p.rstrip("/")
    anchored = "/" in p
    p, out, i = p.lstrip("/"), "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            end = p.index("]", i + 2)
            out, i = out + "[" + p[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + ("\\" + p[i] if p[i] in ".^$+{}()|\\]" else p[i]), i + 1
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.*$" if folder else "(?:/.*)?$"), negated, folder


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """By the last line that matches, as ignore files have it."""
    out = F.lit(False)
    for line in patterns:
        if line.strip() and not line.startswith("#"):
            rx, negated, _ = glob_regex(line.strip())
            out = F.when(path.rlike(rx), F.lit(not negated)).otherwise(out)
    return out


def url_type(url: Column) -> Column:
    low, path = F.lower(url), F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    return (
        F.when(low.contains("twitter.com") | low.contains("x.com"), "tweet").when(low.contains("arxiv.org"), "arxiv").when(low.contains("github.com"), "github")
        .when(low.contains("youtube.com") | low.contains("youtu.be"), "youtube").when(path.endswith(".pdf"), "pdf")
        .when(path.rlike(r"\.(png|jpg|jpeg|webp|gif)$"), "image").otherwise("webpage")
    )


def html_text(html: Column, most: int = 8000) -> Column:
    """Text of a page: scripts, styles and tags out, blanks collapsed, cut to ``most`` characters."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")
    return F.substring(F.btrim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"\s+", " ")), 1, most)


def html_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, href, n) of the links of each page."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\s[^>]*?href=["']([^"'#]+)"""), F.lit(1))
    return pages.select(key, F.explode(hrefs).alias("href")).groupBy(key, "href").agg(F.count(F.lit(1)).alias("n"))


def arxiv_fields(html: Column) -> dict[str, Column]:
    return {
        "arxiv_id": F.regexp_extract(html, r"(\d{4}\.\d{4,5})", 1),
        "title": F.btrim(F.regexp_extract(html, r"(?is)<h1[^>]*class=\"title[^\"]*\"[^>]*>(?:<span[^>]*>.*?</span>)?(.*?)</h1>", 1)),
        "abstract": F.btrim(F.regexp_extract(html, r"(?is)<blockquote[^>]*class=\"abstract[^\"]*\"[^>]*>(?:<span[^>]*>.*?</span>)?(.*?)</blockquote>", 1)),
    }


def fixed_slices(docs: DataFrame, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, i, slice): gap-free slices of at most ``most`` characters."""
    n = F.ceil(F.greatest(F.length(text), F.lit(1)) / F.lit(most)).cast("int")
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text), i * most + 1, F.lit(most)))).alias("i", "slice"))


def best_slices(docs: DataFrame, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, i, slice): as ``fixed_slices``, cut before a heading, after a blank line or after a line where there is one.

    The cut of one slice decides where the next begins, so this walks each text in an Arrow batch.
    """
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text], strict=True):
                at, i = 0, 0
                while at < len(t) or i == 0:
                    end = min(at + most, len(t))
                    if end < len(t):
                        spots = [(t.rfind(sep, at, end), 1 if sep == "\n#" else len(sep)) for sep in ("\n#", "\n\n", "\n")]
                        end = next((s + add for s, add in spots if s > at), end)
                    rows.append((k, i, t[at:end]))
                    at, i = end, i + 1
            yield pd.DataFrame(rows, columns=[key, "i", "slice"])

    narrow = docs.where(F.col(text).isNotNull()).select(key, text)
    return narrow.mapInPandas(run, f"{key} {narrow.schema[key].dataType.simpleString()}, i int, slice string")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("bigint")


def token_reduction(docs: DataFrame, used: Column) -> DataFrame:
    """One row: tokens of a corpus by its words, tokens used by queries on average, and their ratio."""
    out = docs.agg(F.floor(F.sum(word_count(F.coalesce("text", F.lit("")))) * 100 / 75).cast("bigint").alias("corpus_tokens"), F.round(F.avg(used), 6).alias("query_tokens"))
    return out.withColumn("reduction", F.round(F.col("corpus_tokens") / F.col("query_tokens"), 6))


def evidence(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, verification): unverified where neither a word of a code node's label nor of its id occurs in its file."""
    ids = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9_]+"), lambda x: F.length(x) >= 3)
    n = nodes.where("file_type = 'code'").join(files.select(F.col("path").alias("source_file"), F.lower("content").alias("body")), "source_file")
    found = F.exists(F.concat(ids(F.col("label")), ids(F.col("id"))), lambda x: F.col("body").contains(x))
    return n.select("id", F.when(found, "verified").otherwise("unverified").alias("verification"))


def pack(files: DataFrame, budget: int) -> DataFrame:
    """(path, folder, chunk): files of a folder packed in order into chunks of at most ``budget`` tokens.

    Greedy packing goes through a folder's files in order; they stream through a task sorted, which
    holds the open chunk's size only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder, chunk, used = None, 0, 0
        for b in batches:
            chunks = []
            for own, n in zip(b["folder"], b["tokens"], strict=True):
                if own != folder:
                    folder, chunk, used = own, 0, 0
                if used and used + n > budget:
                    chunk, used = chunk + 1, 0
                used += n
                chunks.append(chunk)
            yield b[["path", "folder"]].assign(chunk=pd.Series(chunks, b.index, "int32"))

    rows = files.select("path", F.regexp_extract("path", r"^(.*)/", 1).alias("folder"), F.col("tokens").cast("bigint").alias("tokens"))
    return rows.repartition("folder").sortWithinPartitions("folder", "path").mapInPandas(run, "path string, folder string, chunk int")
