"""Languages of documents and of each stretch of mixed ones (problem 1), by Bayesian evidence fusion.

Text likelihoods come from a word model fitted on a bounded sample of labelled documents; scripts settle the languages
that have their own. Declared labels, language codes in addresses and host priors, smoothed along global → host → owner
by grouped aggregation and without the text's own vote, are added as log-odds. A text whose words the model mostly
doesn't know is in none of the languages (``und``).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlas.llm import residue
from stratlas.llm.prose import WORD, sentences
from stratlas.session import materialise, read

LANGS = ("en", "de", "fr", "es", "pt", "it", "nl", "pl", "ru", "zh", "ja")
#: Other spellings of the languages' labels.
ALIASES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français francais", "es": "spa spanish castilian español castellano",
    "pt": "por portuguese português", "it": "ita italian italiano", "nl": "nld dut dutch nederlands", "pl": "pol polish polski",
    "ru": "rus russian русский", "zh": "zho chi chinese cmn mandarin 中文 汉语 漢語 简体中文 繁體中文", "ja": "jpn japanese jp 日本語",
}
#: Frequent words that start the model off; the fit adds all others.
SEEDS = {
    "en": "the and is of to with that for this when from it", "de": "der die das und ist nicht mit wenn für eine werden auch",
    "fr": "le les est une pour des avec vous nous dans que plus", "es": "el los una con para que si la de después desde se",
    "pt": "o os uma com para não são você depois desde que do", "it": "il gli una con per che non sono dopo dalla è di",
    "nl": "de het een niet van voor meer dat met zonder wordt ook", "pl": "nie się jest oraz przez dla po od który jeśli można i",
}
OTHER = "und"
CODES = (*LANGS, OTHER)
CYRILLIC, KANA, HAN = re.compile(r"[\u0400-\u04ff]"), re.compile(r"[\u3040-\u30ff]"), re.compile(r"[\u3400-\u9fff]")
WIDE = re.compile(r"[\u0400-\u9fff]")
RU, ZH, JA = LANGS.index("ru"), LANGS.index("zh"), LANGS.index("ja")
FLOOR = 5e-4  # share of a language's sentences that a word it never had is taken to be in
NO_SCRIPT = 4.0  # nats against a language of another script for each known word of a sentence without a letter of that script, up to three
SWITCH = 12.0  # nats that a change of language between sentences must be worth
STRANGE, KNOWN = 1.5, -5.0  # nats for none of the languages: for a word that the model doesn't know, and for one that it does
CLEAR = 2.0  # nats by which a sentence's best language must lead to count as evidence of a change
ADDRESS, DECLARED = 1.5, 2.0  # log-odds of a language code in the address, and of one declared in the markup
HOST_ROWS = 10.0  # rows that a parent's distribution weighs when its child's is smoothed


def label_code(column: Column) -> Column:
    """The language that a declared label names, in whatever spelling; null if it names none."""
    base = F.regexp_extract(F.lower(column), r"(\p{L}+)", 1)  # its first word
    names = {n: code for code in LANGS for n in [code, *ALIASES[code].split()]}
    pairs = [x for n, code in sorted(names.items()) for x in (F.lit(n), F.lit(code))]
    return F.element_at(F.create_map(*pairs), base)


def address_code(column: Column) -> Column:
    """The language code in an address's folders or before its suffix (``docs/fr/x.md``, ``readme.fr.md``), else null."""
    found = F.regexp_extract(F.lower(column), r"(?:^|[/._-])(" + "|".join(LANGS) + r")(?:[-_][a-z]{2})?(?:/|\.[a-z]+$)", 1)
    return F.when(found != "", found)


DECLARES = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2})", re.I)


def markup_language(text: str) -> str | None:
    """The language that the text's own markup declares."""
    match = DECLARES.search(text) if "<html" in text or "<HTML" in text else None
    return match.group(1).lower() if match and match.group(1).lower() in LANGS else None


@dataclass
class WordModel:
    """Log-likelihood of words under each language; words unknown to it say nothing."""

    index: dict[str, int]
    table: np.ndarray

    def score(self, texts: list[list[str]]) -> list[np.ndarray]:
        """A (sentences × languages) matrix of log-likelihoods of each text's sentences; the last column is for none of them."""
        numbers: list[int] = []
        ends: list[int] = []
        strange: list[int] = []
        extra: list[tuple[int, int, int, int]] = []
        get = self.index.get
        row = 0
        for text in texts:
            for sentence in text:
                unknown = 0
                for word in set(WORD.findall(sentence.lower())):
                    n = get(word)
                    if n is not None:
                        numbers.append(n)
                    else:
                        unknown += 1
                ends.append(len(numbers))
                strange.append(unknown)
                if not sentence.isascii() and WIDE.search(sentence):
                    extra.append((row, len(CYRILLIC.findall(sentence)), len(KANA.findall(sentence)), len(HAN.findall(sentence))))
                row += 1
        count = len(LANGS)
        total = np.zeros((row, count + 1), np.float32)
        at = np.array(ends, np.int64)
        known = at - np.r_[0, at[:-1]] if row else at
        if numbers:
            sums = np.cumsum(self.table[np.array(numbers)], axis=0, dtype=np.float64)
            sums = np.vstack([np.zeros((1, count)), sums])
            total[:, :count] += (sums[at] - sums[at - known]).astype(np.float32)
        total[:, count] = KNOWN * known + STRANGE * np.array(strange, np.float32)
        # a sentence of names alone says nothing of its script
        absent = (NO_SCRIPT * np.minimum(known, 3)).astype(np.float32)
        total[:, [RU, ZH, JA]] -= absent[:, None]
        for r, cyrillic, kana, han in extra:
            total[r, RU] += absent[r] * (cyrillic > 0)
            total[r, [ZH, JA]] += absent[r] * (kana + han > 0)
            add = np.full(count + 1, -0.7 * (cyrillic + kana + han), np.float32)
            add[RU] = 0.0 if cyrillic else add[RU]
            add[JA] = -0.1 * han if kana else -0.35 * han
            add[ZH] = -1.5 * kana if han else add[ZH]
            add[count] = -0.7 * (kana + han)
            total[r] += add
        sizes = np.cumsum([len(t) for t in texts])[:-1] if texts else []
        return np.split(total, sizes)


def fit(labelled: list[tuple[str, str | None, str]], rounds: int = 2) -> WordModel:
    """Fit the word model on ``(text, language or None, owner)``.

    Sentences first take their document's label, then, in each round, the language the model gives them:
    wrong labels and mixed documents lose their hold. A word must stand in documents of several owners, else it is taken
    for a project's name; it counts once per sentence.
    """
    docs = [([set(WORD.findall(s.lower())) for s in sentences(t)], t, label, owner) for t, label, owner in labelled]
    owners: dict[str, set[str]] = defaultdict(set)
    for bags, _, _, owner in docs:
        for bag in bags:
            for word in bag:
                if len(owners[word]) < 8:
                    owners[word].add(owner)
    least = min(5, max(2, len(docs) // 400))
    seeds = {w for ws in SEEDS.values() for w in ws.split()}
    words = sorted(seeds | {w for w, o in owners.items() if len(o) >= least})
    index = {w: i for i, w in enumerate(words)}
    counts = np.zeros((len(words), len(LANGS)))
    sizes = np.zeros(len(LANGS))

    def seeded() -> None:
        counts[:] = 0
        sizes[:] = 1
        for code, ws in SEEDS.items():
            for w in ws.split():
                counts[index[w], LANGS.index(code)] += 2
            sizes[LANGS.index(code)] += 6

    def table() -> np.ndarray:
        # one floor for all: a language of few sentences must not gain from words it never had
        return np.log(np.clip(counts / (sizes + 5.0), FLOOR, 0.9)).astype(np.float32)

    seeded()
    for bags, _, label, _ in docs:
        if label in LANGS:
            k = LANGS.index(label)
            for bag in bags:
                sizes[k] += 1
                for word in bag:
                    n = index.get(word)
                    if n is not None:
                        counts[n, k] += 1
    model = WordModel(index, table())
    for _ in range(rounds):
        scores = model.score([sentences(t) for _, t, _, _ in docs])
        seeded()
        for (bags, _, _, _), score in zip(docs, scores):
            for bag, line in zip(bags, score[:, : len(LANGS)]):
                k = int(line.argmax())
                if line[k] - np.partition(line, -2)[-2] > CLEAR:
                    sizes[k] += 1
                    for word in bag:
                        n = index.get(word)
                        if n is not None:
                            counts[n, k] += 1
        model = WordModel(index, table())
    return model


def segments(score: np.ndarray) -> list[np.ndarray]:
    """Summed log-likelihoods of each longest stretch in one language (Viterbi with a price on each switch).

    Sentences without evidence go with their neighbours. A text whose clear sentences agree is one segment. Only a
    whole text can be in none of the languages.
    """
    if not len(score):
        return []
    whole, score = score, score[:, : len(LANGS)]
    best = score.argmax(1)
    top = score[np.arange(len(score)), best]
    rest = score.copy()
    rest[np.arange(len(score)), best] = -np.inf
    clear = top - rest.max(1) > CLEAR
    if len(set(best[clear].tolist())) <= 1 or whole[:, -1].sum() > score.max(1).sum():
        return [whole.sum(0)]
    value = score[0].copy()
    back = []
    for line in score[1:]:
        jump = value.max() - SWITCH
        came = np.where(value >= jump, np.arange(len(LANGS)), value.argmax())
        back.append(came)
        value = np.maximum(value, jump) + line
    path = [int(value.argmax())]
    for came in reversed(back):
        path.append(int(came[path[-1]]))
    path.reverse()
    out, start = [], 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[start]:
            out.append(whole[start:i].sum(0))
            start = i
    if len(out) > 1:
        for part in out:
            part[-1] = -np.inf
    return out


def letter_count(text: str, enough: int = 20) -> int:
    """Letters of a text; counting stops where its beginning already has ``enough``."""
    start = sum(map(str.isalpha, text[:400]))
    return start if start >= enough else sum(map(str.isalpha, text))


def sample_model(documents: DataFrame, bound: int = 4000) -> WordModel:
    """The word model of about ``bound`` labelled documents, the ones of smallest id hash: all the driver ever holds.

    Their number gives the share of the hash range that holds 1.2 times ``bound`` of them, so that neither a task nor the
    shuffle carries more texts than that, whatever the corpus's size.
    """
    labels = documents.select("doc_id", "text", label_code(F.col("lang")).alias("label"), F.coalesce("full_name", F.lit("")).alias("owner"))
    labels = labels.where("label is not null")
    share = min(1.0, 1.2 * bound / max(1, labels.count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    rows = labels.where(place < F.lit(int(share * (1 << 40)) + 1)).where(F.length(F.col("text").cast("string")) > 40)
    taken = rows.orderBy(place, "doc_id").limit(bound).collect()
    return fit([(r["text"], r["label"], r["owner"]) for r in taken])


def readings(texts: DataFrame, model: WordModel) -> DataFrame:
    """One pass over all texts: each one's segments' likelihoods, its letters, and its residue signature if it has one."""
    shared = texts.sparkSession.sparkContext.broadcast((model.index, model.table))  # bounded by the sample's words
    schema = "origin string, row_id long, source string, owner string, host string, label string, address string, declared string, letters int, segs array<array<float>>, parts " + residue.PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordModel(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = batch.column(batch.schema.get_field_index("text")).to_pylist()
                names = batch.column(batch.schema.get_field_index("name")).to_pylist()
                scores = words.score([sentences(t) for t in rows])
                marks = [residue.signature(t, n) for t, n in zip(rows, names)]
                letters = [letter_count(t) for t in rows]
                keep = [batch.column(batch.schema.get_field_index(c)) for c in ("origin", "row_id", "source", "owner", "host", "label", "address")]
                declared = [markup_language(t) for t in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        *keep, pa.array(declared, pa.string()), pa.array(letters, pa.int32()), pa.array([segments(s) for s in scores], pa.list_(pa.list_(pa.float32()))),
                        pa.array(marks, residue.ARROW_PARTS),
                    ],
                    names=["origin", "row_id", "source", "owner", "host", "label", "address", "declared", "letters", "segs", "parts"],
                )

    return texts.mapInArrow(run, schema)


def labelled_texts(repo: DataFrame, documents: DataFrame) -> DataFrame:
    """Texts of both tables with their owner, host, and the evidence declared beside them.

    ``label`` is a language code, ``!en`` for a flag that says another language than English, or null.
    """
    extra_d = documents.select(
        F.lit("documents").alias("origin"), F.col("doc_id").cast("long").alias("row_id"), F.col("full_name").alias("owner"),
        F.lower(F.trim("source")).alias("host"), label_code(F.col("lang")).alias("label"), address_code(F.col("path")).alias("address"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.element_at(F.split("full_name", "/"), -1), F.lit("")).alias("name"), F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"),
    )
    flag = F.when(F.col("non_english"), F.lit("!en")).when(~F.col("non_english"), F.lit("en"))
    extra_r = repo.select(
        F.lit("clean_text").alias("origin"), F.col("id").cast("long").alias("row_id"), F.col("full_name").alias("owner"),
        F.col("host").alias("host"), flag.alias("label"), F.lit(None).cast("string").alias("address"), F.col("clean_text").cast("string").alias("text"),
        F.coalesce(F.element_at(F.split("full_name", "/"), -1), F.lit("")).alias("name"), F.coalesce(F.lower(F.trim("host")), F.lit("")).alias("source"),
    )
    both = extra_d.unionByName(extra_r).where(F.col("row_id").isNotNull() & (F.length(F.trim("text")) > 0))
    return both.select("origin", "row_id", "name", "source", "text", "owner", "host", "label", "address")


VOTE = "aggregate(segs, array_repeat(0D, 12), (a, s) -> zip_with(a, s, (x, y) -> x + y))"
HOT = 256


def argmax(array: Column) -> Column:
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def with_votes(read_: DataFrame) -> DataFrame:
    """Readings with ``k``, each text's own best language."""
    return read_.withColumn("k", F.when(F.size("segs") > 0, argmax(F.expr(VOTE))))


def with_counts(rows: DataFrame) -> tuple[DataFrame, list[float]]:
    """Rows with the language counts of their owner and host, ``no`` and ``nh``, and the smoothed global distribution.

    Owners that hold over 1/``HOT`` of all texts are fewer than ``HOT``; they travel by broadcast, as do hosts while
    they are as few. The others are joined by key; rows without an owner, or of a hot one, are spread by their ids.
    """
    size = len(CODES)
    tally = [F.sum(F.when(F.col("k") == i, 1.0).otherwise(0.0)).alias(f"n{i}") for i in range(size)]
    counts = materialise(rows.where("k is not null").groupBy("owner", "host").agg(*tally), "language-counts")
    again = [F.sum(f"n{i}").alias(f"n{i}") for i in range(size)]
    whole = counts.agg(*again).first()
    total = sum(v or 0 for v in whole)
    world = [((v or 0) + 1.0) / (total + size) for v in whole]
    each = F.array(*[f"n{i}" for i in range(size)])

    def join(rows: DataFrame, key: str, name: str) -> DataFrame:
        held = counts.where(F.col(key).isNotNull()).groupBy(key).agg(*again).select(F.col(key).alias("join_key"), each.alias(name))
        hot = F.aggregate(name, F.lit(0.0), lambda a, x: a + x) * HOT > F.lit(total)
        few = held.where(hot).select(F.col("join_key").alias("hot_key"), F.col(name).alias("hot_n"))
        marked = rows.join(F.broadcast(few), F.col(key) == F.col("hot_key"), "left")
        spread = F.concat(F.lit("\u0000"), F.col("origin"), F.col("row_id").cast("string"))
        marked = marked.withColumn("join_key", F.when(F.col(key).isNull() | F.col("hot_n").isNotNull(), spread).otherwise(F.col(key)))
        return marked.join(held.where(~hot), "join_key", "left").withColumn(name, F.coalesce("hot_n", name)).drop("join_key", "hot_key", "hot_n")

    return join(join(rows, "host", "nh"), "owner", "no"), world


def left_out_prior(world: list[float]) -> Column:
    """The text's prior: its owner's distribution smoothed to its host's, that to the global one, without its own vote."""
    nothing = F.array_repeat(F.lit(0.0), len(CODES))
    own = F.transform(F.sequence(F.lit(0), F.lit(len(CODES) - 1)), lambda i: (i == F.col("k")).cast("double"))

    def smoothed(name: str, parent: Column) -> Column:
        counts = F.when(F.col(name).isNull(), nothing).otherwise(F.zip_with(name, own, lambda n, o: F.greatest(n - F.coalesce(o, F.lit(0.0)), F.lit(0.0))))
        total = F.aggregate(counts, F.lit(HOST_ROWS), lambda a, x: a + x)
        return F.zip_with(counts, parent, lambda n, p: (n + HOST_ROWS * p) / total)

    return smoothed("no", smoothed("nh", F.array(*[F.lit(p) for p in world])))


def label_odds(rows: DataFrame) -> dict[str, float]:
    """How far a declared label is to be trusted: its log-odds, from how often it agrees with the text's own language."""
    codes = F.array(*[F.lit(c) for c in CODES])
    one = rows.where("label is not null and size(segs) = 1").select("origin", "label", codes[F.col("k")].alias("lang"))
    agrees = F.when(F.col("label") == "!en", F.col("lang") != "en").otherwise(F.col("label") == F.col("lang"))
    rates = one.groupBy("origin").agg(F.avg(agrees.cast("double")).alias("r")).collect()  # a row per origin
    return {r["origin"]: float(np.log(np.clip(r["r"], 0.5, 0.98) / (1 - np.clip(r["r"], 0.5, 0.98)))) for r in rates}


def fused(read_: DataFrame) -> DataFrame:
    """``(origin, row_id, …, found)``: the segments' languages and confidences, likelihoods and all other evidence added up.

    A text without a sentence has no evidence of its own; the others' speaks for it.
    """
    votes = with_votes(read_)
    odds = label_odds(votes)
    trust = F.lit(0.0)
    for origin, value in sorted(odds.items()):
        trust = F.when(F.col("origin") == origin, F.lit(value)).otherwise(trust)
    joined, world = with_counts(votes)
    says = [
        F.when(F.col("label") == c, trust).when((F.col("label") == "!en") & F.lit(c != "en"), trust).otherwise(F.lit(0.0))
        + F.when(F.col("address") == c, F.lit(ADDRESS)).otherwise(F.lit(0.0))
        + F.when(F.col("declared") == c, F.lit(DECLARED)).otherwise(F.lit(0.0))
        for c in CODES
    ]
    rows = joined.withColumn("prior", F.zip_with(left_out_prior(world), F.array(*says), lambda p, s: F.log(p) + s))
    rows = rows.withColumn("segs", F.expr(f"if(size(segs) > 0, segs, array(array_repeat(float(0), {len(CODES)})))"))
    rows = rows.withColumn("post", F.expr("transform(segs, s -> zip_with(s, prior, (a, b) -> double(a) + b))"))
    each = F.expr(
        "transform(post, x -> named_struct('k', cast(array_position(x, array_max(x)) - 1 as int), "
        "'confidence', 1D / aggregate(x, 0D, (t, y) -> t + exp(y - array_max(x)))))"
    )
    rows = rows.withColumn("each", each)
    codes = F.array(*[F.lit(c) for c in CODES])
    merged = F.expr("filter(each, (x, i) -> i = 0 or x.k <> each[i - 1].k)")
    return rows.withColumn("found", F.transform(merged, lambda x: F.struct(codes[x["k"]].alias("lang"), x["confidence"].alias("confidence")))).select(
        "origin", "row_id", "source", "label", "letters", "parts", "found"
    )


def languages(repo: DataFrame, documents: DataFrame, bound: int = 4000) -> DataFrame:
    """Every text that isn't null or blank, with its segments' languages (see ``fused``), its letters, and whether it is residue."""
    read_ = materialise(readings(labelled_texts(repo, documents), sample_model(documents, bound)), "language-readings")
    waste = residue.residue_of(read_.where("parts is not null")).withColumn("waste", F.lit(True))
    rows = fused(read_).drop("parts").join(waste, ["origin", "row_id"], "left")
    return rows.withColumn("residue", F.coalesce("waste", F.lit(False))).drop("waste")


def segment_table(rows: DataFrame) -> DataFrame:
    """``(origin, row_id, seg_no, lang, confidence)``: seg_no -1 for a text in one language, else 0, 1, …"""
    out = rows.select("origin", "row_id", "found", F.posexplode("found").alias("i", "s"))
    number = F.when(F.size("found") == 1, F.lit(-1)).otherwise(F.col("i")).cast("long")
    return out.select("origin", "row_id", number.alias("seg_no"), F.col("s.lang").alias("lang"), F.round("s.confidence", 6).alias("confidence"))


def wrong_labels(rows: DataFrame) -> DataFrame:
    """The texts whose label is missing or wrong, and all texts in several languages.

    Texts of fewer than 20 letters, residue, and texts in none of the languages are none.
    """
    lang = F.col("found")[0]["lang"]
    right = F.when(F.col("label") == "!en", lang != "en").when(F.col("origin") == "clean_text", lang == "en").otherwise(F.col("label") == lang)
    clear = (F.col("letters") >= 20) & ~F.col("residue") & (lang != OTHER)
    return rows.where(clear & ((F.size("found") > 1) | F.col("label").isNull() | ~right))


def found(spark: SparkSession, sf: str) -> DataFrame:
    """The cases, each once; a row repeated with other labels or texts gives what each of its forms gives."""
    rows = languages(read(spark, sf, "repo"), read(spark, sf, "documents"))
    return segment_table(wrong_labels(rows)).drop("confidence").distinct()
