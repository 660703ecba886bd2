"""Language identification of pages by Bayesian fusion of four kinds of evidence.

posterior(language) is in proportion to

  text likelihood * P(declared markup language | language) * prior(language | address)

Text: a naive Bayes model of hashed byte trigrams, trained on labelled texts. Neighbouring
trigrams overlap, so the log likelihood of n of them counts as that of n * SPAN / (n + SPAN).
Declared: the ``lang`` attribute of the markup; its reliability isn't assumed but counted,
over all pages, against what their texts say. Address: the last host label (suffix), the
last two (domain) and the host each have expected counts of languages, from grouped
aggregation over all pages; each level is smoothed towards the one above it with the weight
of ``SMOOTHING`` pages, the suffix towards the whole corpus. A page's own text is left out of
the counts that make its prior.

Sample bound: of each language about ``PER_LANGUAGE`` labelled texts, those of the smallest
id hash (whole texts), and ``MAX_LANGUAGES`` languages at most; counts for the model are
summed by Spark, (languages * GRAMS) rows at most reach the driver. Scoring is one
pass over the markup; what is shuffled afterwards is one small row a page. Counts are
pre-aggregated host by host, then from hosts to domains and suffixes, so a hot host costs
no task more than its share; the join back on the host is one that AQE splits.

Edge cases: null or empty markup has no text and no declaration: address and corpus decide;
a null address or one without ``://`` has the empty host, which such pages share; repeated
rows are judged apart; unlabelled and null labels train nothing; without any label
every language is null with posterior 0; an empty table gives an empty result; input columns
can have any names, and those called like a result are replaced.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import byte_bounded, materialize, text_bytes
from quern.llm.url_filter import split_url

GRAM_BITS = 15
GRAMS = 1 << GRAM_BITS
PER_LANGUAGE, MAX_LANGUAGES = 400, 200
SPAN = 20.0
SMOOTHING = 5.0
RESULTS = ("host", "declared", "text_language", "language", "posterior")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_ENTITY = re.compile(r"<!--|<(script|style)\b", re.I)
_CLOSERS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style")}
_HTML = re.compile(r"<html\b", re.I)
_DECLARED = re.compile(r"""\blang\s*+=\s*+["']?\s*+([A-Za-z]{2,3})""", re.I)


def grams(text: str) -> np.ndarray:
    """Bucket numbers of the byte trigrams of lower-cased words, each between spaces."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not words:
        return np.zeros(0, "u4")
    b = np.frombuffer(f" {words} ".encode("utf-8", "replace"), "u1").astype("u4")
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)


def without_markup(markup: str) -> str:
    """Comments, script and style elements and tags become spaces; what isn't closed is a tag or text.
    Each end is searched for once, so the time is in proportion to the length."""
    ends: dict[str, list[tuple[int, int]]] = {}
    out, at, no_comment_end = [], 0, False
    while (start := markup.find("<", at)) >= 0:
        end = -1
        if opened := _ENTITY.match(markup, start):
            name = opened[1] and opened[1].lower()
            if name is None:
                end = -1 if no_comment_end else markup.find("-->", start + 4)
                no_comment_end |= end < 0
                end = end + 3 if end >= 0 else -1
            else:
                closers = ends.get(name)
                if closers is None:
                    closers = ends[name] = [m.span() for m in _CLOSERS[name].finditer(markup)]
                k = bisect_left(closers, (opened.end(), 0))
                end = closers[k][1] if k < len(closers) else -1
        if end < 0:
            end = markup.find(">", start) + 1
            if not end:
                break
        out += [markup[at:start], " "]
        at = end
    return "".join([*out, markup[at:]])


def visible_text(markup: str) -> str:
    return html.unescape(without_markup(markup))


def declared_language(markup: str) -> str | None:
    at = 0
    while tag := _HTML.search(markup, at):
        end = markup.find(">", tag.end())
        end = len(markup) if end < 0 else end
        if found := _DECLARED.search(markup, tag.end(), end):
            return found.group(1).lower()
        at = end
    return None


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # (GRAMS, languages)

    def log_likelihoods(self, text: str) -> np.ndarray:
        found = grams(text)
        if not len(found):
            return np.zeros(len(self.languages))
        return self.log_p[found].sum(axis=0) * (SPAN / (len(found) + SPAN))

    def posterior(self, text: str) -> np.ndarray:
        ll = self.log_likelihoods(text)
        p = np.exp(ll - ll.max())
        return p / p.sum()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = totals.setdefault(language, np.zeros(GRAMS, "i8"))
            counts += np.bincount(grams(text or ""), minlength=GRAMS)
    for language, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["language", "gram", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    known = docs.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).cast("string").alias("text"), F.lower(F.col(label_col)).alias("language")).where("language is not null and language <> ''")
    sizes = {r.language: r.n for r in known.groupBy("language").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(sizes)
    if not names:
        return LanguageModel([], np.zeros((GRAMS, 0)))
    below = F.lit(None).cast("double")
    for name in names:
        below = F.when(F.col("language") == name, F.lit(min(1.0, per_language / sizes[name]))).otherwise(below)
    share = (F.col("h") / 2.0**64) + 0.5
    counted = byte_bounded(known.where(share <= below).select("language", "text")).mapInArrow(_count, "language string, gram int, n bigint")
    counts = np.zeros((GRAMS, len(names)))
    for r in counted.groupBy("language", "gram").agg(F.sum("n").alias("n")).collect():
        counts[r.gram, names.index(r.language)] = r.n
    smooth = counts + 0.5
    return LanguageModel(names, np.log(smooth / smooth.sum(axis=0)))


def _evidence(model, html_at: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = model.value
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                declared, found = [], []
                for raw in batch.column(html_at):
                    markup = (raw.as_py() or b"").decode("utf-8", "replace")
                    declared.append(declared_language(markup))
                    found.append(m.posterior(visible_text(markup)).tolist() if m.languages else [])
                columns = [c for k, c in enumerate(batch.columns) if k != html_at]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*columns, pa.array(declared, pa.string()), pa.array(found, pa.list_(pa.float64()))], schema)], schema=schema)

    return run


def _sums(column: str, n: int) -> Column:
    return F.array(*(F.sum(F.element_at(column, i + 1)) for i in range(n))) if n else F.array().cast("array<double>")


def _smoothed(counts: str, above: Column) -> Column:
    """P(language) of a level without the page's own text (``_text``), smoothed towards ``above``."""
    own = F.zip_with(counts, "_text", lambda c, t: F.greatest(c - t, F.lit(0.0)))
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, above, lambda c, p: (c + SMOOTHING * p) / (total + SMOOTHING))


def evidence(pages: DataFrame, model: LanguageModel, url_col: str, html_col: str) -> DataFrame:
    """(page, host, declared, _text): the kept columns as one, and the posterior of the text alone."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in RESULTS and c != html_col]
    host, _ = split_url(F.col(f"`{url_col}`"))
    rows = pages.select(F.struct(*kept).alias("page"), F.coalesce(host, F.lit("")).alias("host"), text_bytes(F.col(f"`{html_col}`")).alias("_html"))
    schema = T.StructType([*rows.drop("_html").schema.fields, T.StructField("declared", T.StringType()), T.StructField("_text", T.ArrayType(T.DoubleType()))])
    return byte_bounded(rows).mapInArrow(_evidence(pages.sparkSession.sparkContext.broadcast(model), rows.columns.index("_html"), to_arrow_schema(schema)), schema)


def identify(pages: DataFrame, model: LanguageModel, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without its markup column, with the columns ``RESULTS``."""
    n = len(model.languages)
    rows = materialize(evidence(pages, model, url_col, html_col), "languages")
    if not n:
        return rows.select("page.*", "host", "declared", *(F.lit(None).cast("string").alias(c) for c in ("text_language", "language")), F.lit(0.0).alias("posterior"))
    names = F.array(*map(F.lit, model.languages))
    last = lambda k: F.array_join(F.slice(F.reverse(F.split("host", r"\.")), 1, k), ".")
    hosts = rows.groupBy("host").agg(_sums("_text", n).alias("c_host")).withColumns({"suffix": last(1), "domain": last(2)})
    hosts = materialize(hosts, "languages")
    domains = hosts.groupBy("domain").agg(_sums("c_host", n).alias("c_domain"))
    suffixes = hosts.groupBy("suffix").agg(_sums("c_host", n).alias("c_suffix"))
    corpus = [x or 0.0 for x in hosts.agg(_sums("c_host", n).alias("c")).first().c]
    addresses = hosts.join(domains, "domain").join(suffixes, "suffix").select("host", "c_host", "c_domain", "c_suffix")
    # what is declared, given the language: MAX_LANGUAGES + 2 rows at most
    kind = F.when(F.col("declared").isNull(), "").when(F.col("declared").isin(*model.languages), F.col("declared")).otherwise("?")
    said = {r.kind: r.c for r in rows.groupBy(kind.alias("kind")).agg(_sums("_text", n).alias("c")).collect()}
    kinds = [*model.languages, "?", ""]
    declared = F.lit(None).cast("array<double>")
    for k in kinds:
        counts = said.get(k, [0.0] * n)
        p = [(counts[i] + (SMOOTHING if k == model.languages[i] else 1.0)) / (corpus[i] + SMOOTHING + len(kinds) - 1) for i in range(n)]
        declared = F.when(kind == k, F.array(*map(F.lit, p))).otherwise(declared)
    flat = F.array(*(F.lit((c + 1) / (sum(corpus) + n)) for c in corpus))
    joined = rows.join(addresses, "host")
    prior = _smoothed("c_host", _smoothed("c_domain", _smoothed("c_suffix", flat)))
    scored = joined.withColumns({"_prior": prior, "_declared": declared})
    scored = scored.withColumn("_joint", F.transform(F.arrays_zip("_text", "_prior", "_declared"), lambda z: z["_text"] * z["_prior"] * z["_declared"]))
    best = F.array_max(F.transform(F.arrays_zip("_joint"), lambda z, i: F.struct(z["_joint"].alias("p"), (-i).alias("at"))))
    text_best = F.array_max(F.transform("_text", lambda p, i: F.struct(p.alias("p"), (-i).alias("at"))))
    total = F.aggregate("_joint", F.lit(0.0), lambda a, x: a + x)
    return scored.select("page.*", "host", "declared", F.element_at(names, 1 - text_best["at"]).alias("text_language"), F.element_at(names, 1 - best["at"]).alias("language"), F.round(best["p"] / total, 6).alias("posterior"))
