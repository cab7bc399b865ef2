"""Languages of documents and of their stretches in another language.

The classifier is a sparse multinomial logistic regression on TF-IDF weighted, hashed character n-grams, trained with
follow-the-regularised-leader (proximal, elastic net) and calibrated by a temperature on held-out lines.  It is fitted
on a bounded, documented sample of labelled documents (``SAMPLE`` for each language, chosen by hash); as some labels are wrong, lines
whose label a first model of the other half of the sample rejects are left out.  Everything else runs
over the whole texts of all documents, in one scan without a shuffle.

A text is judged line by line; lines without a full sentence take part in the document's language only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.words import TAG, chunks

# Codes and names of the languages, as labels give them, without accents and in lower case.
NAMES = {
    "es": "es spa spanish espanol castellano espagnol spanisch spagnolo espanhol",
    "en": "en eng english ingles anglais englisch inglese",
    "fr": "fr fra fre french francais frances franzosisch francese",
    "pt": "pt por portuguese portugues portugais portugiesisch portoghese",
    "it": "it ita italian italiano italien italienisch",
    "de": "de deu ger german deutsch aleman allemand tedesco alemao",
}
LANGS = list(NAMES)
ORDERS = (2, 3, 4)
BUCKET_BITS = 16
NO_BUCKET = 1 << BUCKET_BITS
#: Documents of each labelled language that the classifier is fitted on, and the longest taken (others: skipped whole).
SAMPLE, SAMPLE_CHARS = 300, 12_000
#: Fewest lines of the sample with an n-gram: rarer ones are mostly parts of names.
LEAST_LINES = 10
#: Fewest sentences of a line that can make a document mixed; fewest letters for a line to weigh in its document's language.
LINE_SENTENCES, JUDGED_LETTERS = 2, 25
SENTENCE_WORDS = 3
#: Least confidence of a line in another language than its document, from FULL letters on; shorter ones need more, as ``least_confidence`` has it.
SURE, FULL = 0.9, 80
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
# Months before which a full stop is that of a German date.
_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
_SENTENCE = re.compile(rf"[^\W\d_]{{2}}[^.!?\n]*[.!?…]+[\"'»”)\]]*(?=\s|$)(?!\s+(?:{_MONTHS})\b)")

_letters: np.ndarray | None = None


def label_language(label: Column) -> Column:
    """The language a label names by code or name in any convention; null if it names none of LANGS."""
    plain = F.lower(F.trim(F.translate(label, "áàâãéèêíìóòôõúùüñçöäÁÀÂÃÉÈÊÍÌÓÒÔÕÚÙÜÑÇÖÄ", "aaaaeeeiioooouuuncoaaaaaeeeiioooouuuncoa")))
    head = F.split(plain, r"[-_ (]", 2)[0]
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(head.isin(names.split()), lang).otherwise(out)
    return out


def _letter_table() -> np.ndarray:
    """For each character of the basic plane its lower-case letter without compatibility form, or 32."""
    global _letters
    if _letters is None:
        table = np.full(0x10000, 32, np.uint16)
        for code in range(0x10000):
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                table[code] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else code
        _letters = table
    return _letters


def _prepare(text: str) -> str:
    if "<" in text:
        text = TAG.sub(lambda m: " " * len(m[0]), text)
    return text


class Lines:
    """The lines of some texts, with the buckets of their n-grams."""

    def __init__(self, texts: list[str]):
        clean = [unicodedata.normalize("NFC", _prepare(t)).replace("\r\n", "\n").replace("\r", "\n") for t in texts]
        joined = "\n".join(clean) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.text = joined
        ends = np.nonzero(codes == 10)[0]
        self.first = np.concatenate([[0], ends[:-1] + 1])
        self.end = ends
        text_ends = np.cumsum(np.fromiter(map(len, clean), np.int64, len(clean)) + 1)
        self.owner = np.searchsorted(text_ends, ends, "right")
        low = _letter_table()[np.where(codes < 0x10000, codes, 32)]
        low[ends] = 32
        # A run of anything but letters counts as one space.
        keep = (low != 32) | np.concatenate([[True], low[:-1] != 32])
        keep[ends] = True
        self.chars = low[keep].astype(np.uint64)
        place = np.cumsum(keep)
        self.stop = place[ends]
        self.start = np.concatenate([[0], self.stop[:-1]])
        letters = np.concatenate([[0], np.cumsum(low != 32)])
        self.letters = letters[ends] - letters[self.first]

    def buckets(self, order: int) -> np.ndarray:
        """The bucket of the n-gram that begins at each character; NO_BUCKET where it would reach over its line."""
        n = len(self.chars)
        h = np.full(n, np.uint64(order))
        for k in range(order):
            h[: n - k] *= np.uint64(0x100000001B3)
            h[: n - k] += self.chars[k:]
        h *= _SPREAD
        h >>= np.uint64(64 - BUCKET_BITS)
        out = h.view(np.int64)
        for k in range(1, order + 1):
            out[np.maximum(self.start, self.stop - k)] = NO_BUCKET
        return out

    def sentences(self, i: int) -> int:
        """Sentences of a line; what ends with a full stop after fewer than SENTENCE_WORDS words is an abbreviation or a name."""
        return sum(len(x.split()) >= SENTENCE_WORDS for x in _SENTENCE.findall(self.text[self.first[i] : self.end[i]]))


class Model:
    """Weights by bucket, with the inverse document frequencies multiplied in, bias and temperature."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.weights = np.zeros((len(LANGS), NO_BUCKET + 1), np.float32)
        self.weights[:, :-1] = weights.T
        self.bias, self.temperature = bias, temperature

    def sums(self, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
        """For each line the sum of its n-grams' weights, and their number."""
        total = np.zeros((len(lines.start), len(LANGS)))
        count = np.zeros(len(lines.start))
        for order in ORDERS:
            buckets = lines.buckets(order)
            for k, weights in enumerate(self.weights):
                total[:, k] += np.add.reduceat(weights.take(buckets), lines.start)
            count += np.maximum(0, lines.stop - lines.start - order)
        return total, count

    def probabilities(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        score = (SCALE * total / np.maximum(1, count)[:, None] + self.bias) / self.temperature
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(axis=1, keepdims=True)


#: Term frequencies are relative to the line's length; this brings the features near 1.
SCALE = 30.0


def _features(lines: Lines, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    grams = [lines.buckets(order) for order in ORDERS]
    out = []
    for i in rows:
        a, b = lines.start[i], lines.stop[i]
        own = np.concatenate([g[a : max(a, b - order)] for g, order in zip(grams, ORDERS)])
        index, count = np.unique(own, return_counts=True)
        out.append((index, count / max(1, len(own)) * SCALE))
    return out


def _ftrl(features: list, labels: np.ndarray, passes: int, alpha=0.2, beta=1.0, l1=0.1, l2=0.02, seed=7) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, proximal, one row at a time; the last weight row is the bias."""
    size, rng = (1 << BUCKET_BITS) + 1, np.random.default_rng(seed)
    z, n = np.zeros((size, len(LANGS))), np.zeros((size, len(LANGS)))
    one = np.eye(len(LANGS))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return -np.sign(zi) * np.maximum(0, np.abs(zi) - l1) / ((beta + np.sqrt(ni)) / alpha + l2)

    for _ in range(passes):
        for k in rng.permutation(len(features)):
            index, x = features[k]
            at, value = np.append(index, size - 1), np.append(x, 1.0)[:, None]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            score = (w * value).sum(axis=0)
            p = np.exp(score - score.max())
            g = value * (p / p.sum() - one[labels[k]])
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[at] = more
    w = weights(z, n)
    return w[:-1], w[-1]


def _damaged(text: str, how: int) -> str:
    """The text as documents also come: without accents, or with a damaged encoding."""
    if how == 0:
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.encode("utf-8", "replace").decode("latin-1")


def fit(texts: list[str], labels: list[str], passes: int = 3) -> Model:
    """Fit on labelled texts; a tenth of the lines is held out for the temperature.

    Every third text is learnt without accents too, every ninth with a damaged encoding.
    """
    more = [k for k in range(len(texts)) if k % 3 == 0]
    texts = texts + [_damaged(texts[k], k % 9 == 0) for k in more]
    labels = labels + [labels[k] for k in more]
    lines = Lines(texts)
    rows = np.nonzero(lines.letters >= JUDGED_LETTERS)[0]
    if not len(rows):
        return Model(np.zeros((1 << BUCKET_BITS, len(LANGS))), np.zeros(len(LANGS)))
    y = np.array([LANGS.index(x) for x in labels])[lines.owner[rows]]
    features = _features(lines, rows)
    df = np.bincount(np.concatenate([f for f, _ in features]), minlength=1 << BUCKET_BITS)
    idf = np.where(df < LEAST_LINES, 0, np.log((1 + len(features)) / (1 + df)) + 1)
    features = [(f, x * idf[f]) for f, x in features]
    held = np.arange(len(rows)) % 10 == 9
    use = np.nonzero(~held)[0]
    # The languages take part alike whatever their shares.
    rng = np.random.default_rng(3)
    most = max(50, int(np.median([(y[use] == k).sum() for k in np.unique(y[use])])))
    use = np.concatenate([rng.permutation(use[y[use] == k])[: 3 * most] for k in np.unique(y[use])])

    def train(use: np.ndarray, passes: int) -> Model:
        w, b = _ftrl([features[k] for k in use], y[use], passes)
        return Model(w * idf[:, None], b)

    def judge(model: Model) -> np.ndarray:
        total, count = model.sums(lines)
        return model.probabilities(total[rows], count[rows])

    # Some labels are wrong: each half of the texts is judged by a model of the other half before both are learnt.
    source = np.concatenate([np.arange(len(labels) - len(more)), np.array(more, np.int64)])
    half = source[lines.owner[rows]] % 2
    good = np.zeros(len(y), bool)
    for k in (0, 1):
        judged = judge(train(use[half[use] != k], 1)) if (half[use] != k).any() else np.ones((len(y), len(LANGS)))
        good |= (half == k) & (judged[np.arange(len(y)), y] > 0.5)
    model = train(use[good[use]], passes)
    check = np.nonzero(held & good)[0]
    if len(check):
        total, count = model.sums(lines)
        score = SCALE * total[rows[check]] / np.maximum(1, count[rows[check]])[:, None] + model.bias

        def loss(t: float) -> float:
            s = score / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(check)), y[check]]).mean())

        model.temperature = float(min(np.geomspace(0.2, 5, 41), key=loss))
    return model


def sample(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", each: int = SAMPLE) -> pd.DataFrame:
    """At most about ``each`` documents of every labelled language, by the hash of their id."""
    rows = documents.select(F.xxhash64(F.col(key)).alias("h"), F.col(text).alias("text"), label_language(F.col(lang)).alias("label"))
    rows = rows.where(F.col("label").isNotNull() & F.length("text").between(JUDGED_LETTERS, SAMPLE_CHARS))
    # Counted without the texts: texts that are too short or too long only make the sample smaller.
    counts = {r["label"]: r["count"] for r in documents.groupBy(label_language(F.col(lang)).alias("label")).count().where("label is not null").collect()}
    part = F.lit(0.0)
    for label, n in counts.items():
        part = F.when(F.col("label") == label, float(each) / n).otherwise(part)
    kept = rows.where(F.pmod("h", F.lit(1 << 30)) < part * float(1 << 30))
    return kept.select("h", "text", "label").toPandas().sort_values(["h", "text"])


def least_confidence(letters: np.ndarray) -> np.ndarray:
    """The confidence that makes a line count as in another language: what may be wrong shrinks with the square of its letters."""
    return 1 - (1 - SURE) * np.minimum(1, letters / FULL) ** 2


def _judge_batch(model: Model, ids: list, texts: list[str]) -> list[tuple]:
    lines = Lines(texts)
    total, count = model.sums(lines)
    p = model.probabilities(total, count)
    best, sure = p.argmax(axis=1), p.max(axis=1)
    weight = np.where(lines.letters >= JUDGED_LETTERS, lines.letters, 0)
    whole = np.bincount(lines.owner * len(LANGS) + best, weight, len(texts) * len(LANGS)).reshape(-1, len(LANGS))
    bounds = np.searchsorted(lines.owner, np.arange(len(texts) + 1))
    doc_total, doc_count = np.add.reduceat(total, bounds[:-1]), np.add.reduceat(count, bounds[:-1])
    doc_p = model.probabilities(doc_total, doc_count)
    out = []
    for d, doc in enumerate(ids):
        a, b = bounds[d], bounds[d + 1]
        if not doc_count[d]:
            continue
        main = int(whole[d].argmax()) if whole[d].any() else int(doc_p[d].argmax())
        firm = (lines.letters[a:b] > 0) & (sure[a:b] >= least_confidence(lines.letters[a:b]))
        foreign = a + np.nonzero(firm & (best[a:b] != main))[0]
        foreign = [i for i in foreign if lines.sentences(i) >= LINE_SENTENCES]
        if not foreign and (firm & (best[a:b] != main)).any():
            # The lines of several sentences may be the longer part, and the rest of the document in another language.
            rest = [i for i in a + np.nonzero(firm)[0] if best[i] != main or lines.sentences(i) < LINE_SENTENCES]
            shares = np.bincount(best[rest], lines.letters[rest], len(LANGS))
            if len(rest) < firm.sum() and shares.argmax() != main and shares.max() >= JUDGED_LETTERS:
                foreign = [i for i in a + np.nonzero(firm)[0] if best[i] == main and lines.sentences(i) >= LINE_SENTENCES]
                main = int(shares.argmax())
        if not foreign:
            out.append((doc, 0, 0, int(b - a), LANGS[main], float(doc_p[d, main]), LANGS[main], float(doc_p[d, main]), [LANGS[main]]))
            continue
        spoken = [main] + [int(x) for x in dict.fromkeys(best[foreign].tolist())]
        chosen = np.where(firm, best[a:b], main)
        strange = np.zeros(b - a, bool)
        strange[np.array(foreign, np.int64) - a] = True
        chosen[~strange] = main
        turns = np.concatenate([[0], np.nonzero(np.diff(chosen))[0] + 1, [b - a]])
        for k, (s, e) in enumerate(zip(turns[:-1], turns[1:])):
            lang = int(chosen[s])
            q = model.probabilities(total[a + s : a + e].sum(axis=0)[None], count[a + s : a + e].sum()[None])[0, lang]
            out.append((doc, k, int(s), int(e), LANGS[lang], float(q), LANGS[main], float(doc_p[d, main]), [LANGS[x] for x in spoken] if k == 0 else None))
    return out


def _scan(shared) -> Callable:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.string())
    names = ["doc_id", "segment", "first_line", "end_line", "lang", "confidence", "doc_lang", "doc_confidence", "spoken", "given"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = list(zip(batch["doc_id"].to_pylist(), batch["given"].to_pylist())), batch["text"].to_pylist()
            for s in chunks(texts, 400_000):
                rows = [(doc, *rest, given) for (doc, given), *rest in _judge_batch(shared.value, ids[s], texts[s])]
                columns = list(zip(*rows)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def languages(documents: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A row for each stretch of lines in one language.

    (doc_id, segment, first_line, end_line, lang, confidence, doc_lang, doc_confidence, spoken, given): spoken, on a
    document's first row, lists its main language and those of whole lines with two or more sentences in another;
    given is the language that the label names.
    Null texts and texts without a letter have no rows; repeated rows come once each; an empty table, or one without
    any label, gives an untrained model, whose confidences are all a sixth.
    """
    spark = documents.sparkSession
    if model is None:
        rows = sample(documents, key, text, lang)
        model = fit(rows["text"].tolist(), rows["label"].tolist())
    texts = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), label_language(F.col(lang)).alias("given")).where(F.col("text").isNotNull() & (F.length("text") > 0))
    return texts.mapInArrow(
        _scan(spark.sparkContext.broadcast(model)),
        "doc_id bigint, segment int, first_line int, end_line int, lang string, confidence double, doc_lang string, doc_confidence double, spoken array<string>, given string",
    )


def wrong_labels(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang) of the documents without a right label: the true language; for mixed ones, each language.

    Texts without a letter are no cases; a document that comes in several rows has each pair once; an empty table gives
    no rows.
    """
    judged = languages(documents, model).where("segment = 0")
    wrong = (F.size("spoken") > 1) | F.col("given").isNull() | (F.col("given") != F.col("spoken")[0])
    return judged.where(wrong).select("doc_id", F.explode("spoken").alias("lang")).distinct()
