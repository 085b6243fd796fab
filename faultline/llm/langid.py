"""Language identification by Bayesian evidence fusion.

For each language the log posterior adds three pieces of evidence: a tempered
text likelihood (hashed byte trigrams), the likelihood of the declared markup
language, and a prior for the host the text came from. The prior is smoothed
along a hierarchy, host towards its address suffix, suffix towards the whole
corpus, with counts of the texts' own verdicts from grouped aggregations over
all rows; a row's own verdict is left out of its prior. The likelihood of a
declaration is counted the same way, as verdict against declaration.

The trigram model is trained on rows that declare one of the languages, a
hashed sample of about ``SAMPLE`` rows per language (the bound of the training
set); everything else is counted over all rows. The model is a table of
``BINS`` x languages numbers whatever the corpus, so it is broadcast; the prior
of hosts is a table as long as there are hosts and is joined by host.

Defined cases: a null or blank text, one without a letter and one in none of
the languages have the language null and are not accepted; null declarations,
hosts or suffixes are no evidence; declarations outside the languages count as
one further value; equal posteriors take the alphabetically first language;
very long texts are read whole, their trigrams added up piece by piece;
repeated rows and extra columns are kept as they are, whatever their names (but
a column named like the verdict, one struct column, is replaced); without any
labelled row no language is known and nothing is accepted; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from faultline.llm.common import map_batches, prepare, utf8
from faultline.llm.html_extract import DROP, read_page
from faultline.session import materialize

#: Languages that are told apart.
LANGUAGES = ("de", "en", "es", "fr")
#: Training rows per language, about (a hashed sample when there are more).
SAMPLE = 4000
#: Hash bins of the trigrams, and the count added to each.
BINS, ADD = 1 << 16, 0.5
#: Weight of a training text, in trigrams, however long it is.
DOCUMENT_WEIGHT = 3000
#: Weight of the summed trigram log likelihoods (neighbouring trigrams overlap).
TEMPER = 0.3
#: Strength, in rows, of the parent's share in a smoothed prior, and of even odds in a declaration.
PRIOR_ROWS, DECLARED_ROWS = 20.0, 5.0
#: Log odds of a trigram by which the unknown language stays below the mixture of the known ones.
UNKNOWN_MARGIN = 1.5
#: Smallest posterior that is accepted.
MIN_POSTERIOR = 0.6
#: Bytes handled at a time.
CHUNK = 1 << 20


#: Bytes of a trigram: letters a-z, everything beyond ASCII, and blanks and marks that end words.
SPOKEN = np.isin(np.arange(256), [*range(0x61, 0x7B), *range(0x80, 0x100), *b" \n.,"])


def trigram_bins(text: np.ndarray) -> np.ndarray:
    """Bin of each byte trigram of a lower-cased byte array; numbers, keys and
    symbols speak no language and are left out."""
    ok = SPOKEN[text]
    b = text.astype(np.uint32)
    code = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:])[ok[:-2] & ok[1:-1] & ok[2:]]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


def _texts(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, bytes) in pieces of bounded size; pieces of a text share two bytes."""
    for i, t in enumerate(texts):
        low = b" " + t.lower() + b" "
        for at in range(0, max(len(low) - 2, 0), CHUNK):
            yield i, np.frombuffer(low[at:at + CHUNK + 2], np.uint8)


def text_scores(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over each text's trigrams, and their number."""
    out = np.zeros((len(texts), table.shape[1] + 1))
    rows, bins, size = [], [], 0

    def add() -> None:
        if rows:
            starts = np.r_[0, np.cumsum([len(b) for b in bins])[:-1]]
            sums = np.add.reduceat(table[np.concatenate(bins)], starts, axis=0, dtype=np.float64)
            np.add.at(out, np.array(rows), np.c_[sums, [len(b) for b in bins]])
            rows.clear()
            bins.clear()

    for i, piece in _texts(texts):
        b = trigram_bins(piece)
        if len(b):
            rows.append(i)
            bins.append(b)
            size += len(b)
        if size >= CHUNK:
            add()
            size = 0
    add()
    return out


def train(docs: DataFrame, text: str, declared: str, languages: tuple[str, ...], sample: int) -> np.ndarray | None:
    """Log probabilities (bins, languages); None without labelled rows."""
    labelled = docs.select(F.col(declared).alias("lang"), utf8(text).alias("t")).filter(F.col("lang").isin(*languages))
    n = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not n:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample / c))) for k, c in n.items()])
    picked = labelled.filter(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < share * (1 << 20))

    def make():
        def run(b):
            counts = {}
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, piece in _texts(texts):
                mine = trigram_bins(piece)
                c = counts.setdefault(langs[i], np.zeros(BINS))
                # a text speaks with at most DOCUMENT_WEIGHT trigrams' voice, so that no single one sets the model
                c += np.bincount(mine, minlength=BINS) * (1.0 if len(mine) <= DOCUMENT_WEIGHT else DOCUMENT_WEIGHT / len(texts[i]))
            out = [(k, np.flatnonzero(c), c) for k, c in counts.items()]
            return {"lang": [k for k, at, _ in out for _ in at], "bin": np.concatenate([np.zeros(0, np.int64), *[at for _, at, _ in out]]),
                    "n": np.concatenate([np.zeros(0), *[c[at] for _, at, c in out]])}
        return run

    counted = map_batches(picked, make, "lang string, bin int, n double").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = np.full((BINS, len(languages)), ADD)
    for r in counted.toLocalIterator():  # at most bins x languages rows
        table[r["bin"], languages.index(r["lang"])] += r["n"]
    known = np.array([k in n for k in languages])
    logs = np.log(table / table.sum(axis=0))
    logs[:, ~known] = -np.log(BINS) - 5.0  # a language without rows is never the best
    return logs


def unknown_column(logs: np.ndarray) -> np.ndarray:
    """The unknown language: what the languages have in common, less a margin
    for each trigram, and never below an even chance among a third of the bins."""
    mixture = np.logaddexp.reduce(logs, axis=1, keepdims=True) - np.log(logs.shape[1])
    return np.maximum(mixture - UNKNOWN_MARGIN, -np.log(BINS / 3))


def _scored(docs: DataFrame, text: str, table) -> DataFrame:
    """``docs`` with ``_lid``: log likelihood per language, then of the unknown
    language, then the number of trigrams; null for a text without a letter."""
    names = docs.columns
    out_schema = StructType([*docs.schema.fields, StructField("_lid", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = table.value
        full = np.c_[logs, unknown_column(logs)].astype(np.float32)
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            scores = text_scores(texts, full)
            ok = [any(ch.isalpha() for ch in t.decode("utf-8", "replace")) for t in texts]
            col = pa.array([s if k else None for s, k in zip(scores.tolist(), ok, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], col], names=[*names, "_lid"])

    return docs.withColumn("_lid_text", utf8(text)).mapInArrow(run, out_schema)


def identify(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source",
             suffix: Column | None = None, languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE,
             verdict: str = "language_id") -> DataFrame:
    """``docs`` with the struct column ``verdict``: language (null if not
    accepted), best (the language of the highest posterior), posterior,
    text_best, n_trigrams and accepted. ``suffix`` is the address suffix; by
    default the part of the host behind its last dot."""
    spark = docs.sparkSession
    prepare(spark)
    languages = tuple(sorted(languages))
    given = docs.columns
    names = [c for c in given if c != verdict]
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(given)]
    docs = docs.select(*own, *([] if suffix is None else [suffix.cast("string").alias("_lid_given")]))
    text, declared, host = (f"c{given.index(c)}" for c in (text, declared, host))
    kept = [f"c{given.index(c)}" for c in names]
    logs = train(docs, text, declared, languages, sample)
    empty = F.struct(F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("best"),
                     F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_best"),
                     F.lit(0).cast("long").alias("n_trigrams"), F.lit(False).alias("accepted"))
    if logs is None:
        return docs.select(*kept, empty.alias("verdict")).toDF(*names, verdict)
    table = spark.sparkContext.broadcast(logs)
    n_lang = len(languages)
    by_name = F.array(*[F.lit(x) for x in languages])
    host_col = F.col(host).cast("string")
    suffix_col = F.regexp_extract(host_col, r"\.([A-Za-z]+)$", 1) if suffix is None else F.coalesce("_lid_given", F.lit(""))
    known = F.when(F.col(declared).isin(*languages), F.col(declared)).when(F.col(declared).isNotNull(), "").alias("_lid_declared")

    def with_evidence(df: DataFrame) -> DataFrame:
        likelihoods = F.slice("_lid", 1, n_lang)
        best = F.array_position(likelihoods, F.array_max(likelihoods)).cast("int")
        sure = F.array_max(likelihoods) > F.element_at("_lid", n_lang + 1)
        return df.withColumns({"_lid_host": F.coalesce(host_col, F.lit("")), "_lid_suffix": F.coalesce(suffix_col, F.lit("")),
                               "_lid_declared": known, "_lid_best": F.when(sure, best)})

    used = dict.fromkeys([text, declared, host, *docs.columns[len(given):]])
    evidence = with_evidence(_scored(docs.select(*used), text, table))
    # one pass over all rows: verdicts by host, suffix and declaration
    counted = materialize(evidence.filter("_lid_best is not null")
                          .groupBy("_lid_host", "_lid_suffix", "_lid_declared", "_lid_best").agg(F.count(F.lit(1)).alias("n")))

    def per_language(key: list[str], name: str) -> DataFrame:
        sums = [F.coalesce(F.sum(F.when(F.col("_lid_best") == i + 1, F.col("n"))), F.lit(0)).cast("double") for i in range(n_lang)]
        return counted.groupBy(*key).agg(F.array(*sums).alias(name))

    declarations = {r["_lid_declared"]: r["d"] for r in per_language(["_lid_declared"], "d").collect()}  # languages + 2 rows
    whole = np.sum([v for v in declarations.values()], axis=0) if declarations else np.zeros(n_lang)
    corpus = (whole + PRIOR_ROWS / n_lang) / (whole.sum() + PRIOR_ROWS)
    values = [*languages, ""]
    seen = np.array([declarations.get(v, [0.0] * n_lang) for v in values]) + DECLARED_ROWS / len(values)
    said = np.log(seen / seen.sum(axis=0))

    # counts by suffix and host meet the rows by host; hosts without a verdict keep the corpus's prior
    hosts = per_language(["_lid_host", "_lid_suffix"], "_lid_hc").join(per_language(["_lid_suffix"], "_lid_sc"), "_lid_suffix")
    hosts = materialize(hosts).withColumnsRenamed({"_lid_host": "_h", "_lid_suffix": "_s"})
    rows = with_evidence(_scored(docs, text, table))
    rows = rows.join(hosts, (F.col("_lid_host") == F.col("_h")) & (F.col("_lid_suffix") == F.col("_s")), "left")
    # every row leaves its own verdict out of its priors
    own = F.transform(by_name, lambda x, i: F.when(F.col("_lid_best") == i + 1, 1.0).otherwise(0.0))

    def smoothed(counts: Column, parent: Column) -> Column:
        rest = F.zip_with(F.coalesce(counts, F.transform(by_name, lambda x: F.lit(0.0))), own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
        total = F.aggregate(rest, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(rest, parent, lambda c, p: (c + PRIOR_ROWS * p) / (total + PRIOR_ROWS))

    flat = F.array(*[F.lit(float(x)) for x in corpus])
    rows = rows.withColumn("_lid_sp", F.when(F.col("_lid_suffix") == "", flat).otherwise(smoothed(F.col("_lid_sc"), flat)))
    rows = rows.withColumn("_lid_prior", F.when(F.col("_lid_host") == "", F.col("_lid_sp"))
                           .otherwise(smoothed(F.col("_lid_hc"), F.col("_lid_sp"))))
    declared_logs = F.create_map(*[x for v, row in zip(values, said, strict=True)
                                   for x in (F.lit(v), F.array(*[F.lit(float(e)) for e in row]))])
    declared_log = F.coalesce(F.when(F.col("_lid_declared").isNotNull(), F.element_at(declared_logs, F.coalesce("_lid_declared", F.lit("")))),
                              F.array(*[F.lit(0.0)] * n_lang))
    unknown = TEMPER * F.element_at("_lid", n_lang + 1)
    # differences to the unknown language, whose prior is that of an unseen one
    logit = F.zip_with(F.zip_with(F.slice("_lid", 1, n_lang), "_lid_prior", lambda s, p: TEMPER * s - unknown + F.log(p)),
                       declared_log, lambda a, d: a + d)
    rows = rows.withColumn("_lid_logit", F.when(F.col("_lid").isNotNull(), logit))
    top = F.array_max("_lid_logit")
    spread = F.aggregate("_lid_logit", F.exp(F.lit(float(np.log(0.01))) - F.greatest(top, F.lit(0.0))),
                         lambda a, x: a + F.exp(x - F.greatest(top, F.lit(0.0))))
    rows = rows.withColumn("_lid_post", F.exp(top - F.greatest(top, F.lit(0.0))) / spread)
    # element_at of a null place is no null
    best = F.when(top.isNotNull(), F.element_at(by_name, F.array_position("_lid_logit", top).cast("int")))
    accepted = F.coalesce(F.col("_lid_post") >= MIN_POSTERIOR, F.lit(False))
    out = F.struct(F.when(accepted, best).alias("language"), best.alias("best"), F.col("_lid_post").alias("posterior"),
                   F.when(F.col("_lid_best").isNotNull(), F.element_at(by_name, F.col("_lid_best"))).alias("text_best"),
                   F.coalesce(F.element_at("_lid", n_lang + 2), F.lit(0.0)).cast("long").alias("n_trigrams"),
                   accepted.alias("accepted"))
    return rows.select(*kept, out.alias("verdict")).toDF(*names, verdict)


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the column ``text`` (in place of one they have): the page's lines that its markup does not drop."""
    pages = pages.drop("text")
    names = pages.columns
    out_schema = StructType([*pages.schema.fields, StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n".join(t for t, state in read_page(x.decode("utf-8", "replace")) if state != DROP) for x in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array(texts, pa.string())], names=[*names, "text"])

    return pages.withColumn("_lid_html", utf8(html)).mapInArrow(run, out_schema)


def identify_pages(pages: DataFrame, url: str = "url", html: str = "html", verdict: str = "language_id", **options) -> DataFrame:
    """``pages`` without ``html``, with the page's text, the evidence columns of
    ``page_evidence`` and ``verdict``: the declaration is the markup's, host and suffix are the url's."""
    read = materialize(page_text(page_evidence(pages, url, html), html).drop(html))  # each page is parsed once
    return identify(read, "text", "declared", "host", suffix=F.col("suffix"), verdict=verdict, **options)


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with the evidence columns of ``identify``: declared (the lang
    of the html element), host and suffix (from the url)."""
    lang = F.lower(F.regexp_extract(F.col(html), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    host = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return pages.withColumns({"declared": F.when(lang != "", lang), "host": F.when(host != "", host)}) \
        .withColumn("suffix", F.regexp_extract("host", r"\.([a-z]+)$", 1))
