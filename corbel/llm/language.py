"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

DIMS = 2048
UNKNOWN = "und"
# Families of ISO 639-1 codes, fixed values; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("am", "ar", "he", "mt"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "malayic": ("id", "jv", "ms", "tl"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
_BLANK = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], f"={lang}")


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of hashed letter n-grams (1 to 4 bytes of lower-cased text, runs of others one blank); None without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    a = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANK).split()) + b" ", np.uint8).astype(np.uint32)
    out = np.zeros(DIMS, np.float64)
    code = np.zeros(len(a), np.uint32)
    for n in range(1, 5):
        if len(a) < n:
            break
        code = (code[: len(a) - n + 1] << np.uint32(8)) | a[n - 1 :]
        out += np.bincount(((code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(21)).astype(np.int64), minlength=DIMS)
    return np.sqrt(out / out.sum()).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, steps: int = 150) -> np.ndarray:
    """Weights, the last one the offset, of linear machines for the columns of y in -1, 1: squared hinge, accelerated gradient."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    rate = 1 / (1 + 2 * cost * float((x * x).sum(1).mean()))
    w = v = np.zeros((x.shape[1], y.shape[1]), np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (v - 2 * cost / len(x) * (x.T @ (y * slack)))
        w, v = new, new + k / (k + 3) * (new - w)
    return w


@dataclass
class Model:
    """The machine of each family against the others, and of each pair of a family's languages."""

    families: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    within: dict[str, tuple[list[str], list[tuple[int, int]], np.ndarray | None]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> list[tuple[str, str, float]]:
        """Language, family and score of each row."""
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        votes = _chances(x @ self.weights) if len(self.families) > 1 else np.ones((len(x), 1))
        best = votes.argmax(1)
        out: list = [None] * len(x)
        for k, name in enumerate(self.families):
            at = np.flatnonzero(best == k)
            langs, pairs, w = self.within[name]
            chance = np.ones((len(at), 1))
            if w is not None and len(at):
                won = 1 / (1 + np.exp(-3 * (x[at] @ w)))
                chance = np.zeros((len(at), len(langs)))
                for j, (a, b) in enumerate(pairs):
                    chance[:, a] += won[:, j]
                    chance[:, b] += 1 - won[:, j]
                chance /= chance.sum(1, keepdims=True) if len(langs) > 2 else 1
            top = chance.argmax(1)
            for i, t, c in zip(at, top, chance[np.arange(len(at)), top]):
                out[i] = (langs[t], name, float(min(1.0, max(0.0, c * votes[i, k]))))
        return out


def _chances(margins: np.ndarray) -> np.ndarray:
    p = 1 / (1 + np.exp(-3 * margins))
    return p / p.sum(1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray]]) -> Model | None:
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    of, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32)
    kin = np.array([family(r) for r in of])
    model = Model(sorted(set(kin)))
    if len(model.families) > 1:
        model.weights = train_svm(x, np.where(kin[:, None] == np.array(model.families)[None], 1, -1).astype(np.float32))
    for name in model.families:
        own = [g for g in langs if family(g) == name]
        pairs = list(itertools.combinations(range(len(own)), 2))
        ws = []
        for a, b in pairs:
            at = np.flatnonzero((of == own[a]) | (of == own[b]))
            ws.append(train_svm(x[at], np.where(of[at] == own[a], 1, -1).astype(np.float32)[:, None])[:, 0])
        model.within[name] = (own, pairs, np.array(ws).T if ws else None)
    return model


def _vectors(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([None if v is None else v.tobytes() for v in x], pa.binary())], ["lang", "x"])

    return docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "lang string, x binary").where("x is not null")


def learn(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 800, most: int = 16_000) -> Model | None:
    """A model from the labelled rows of ``train``; null labels are left out.

    At most about ``per_language`` rows of each language are used, drawn by a hash of the id, and about ``most`` of all: with very many languages
    fewer of each, but 20 at least. Every language that has a label is learned.
    """
    known = train.where(F.col(lang_col).isNotNull())
    counts = known.groupBy(F.col(lang_col).alias("g")).count().collect()
    if not counts:
        return None
    per_language = min(per_language, max(20, most // len(counts)))
    share = F.create_map(*itertools.chain.from_iterable((F.lit(r["g"]), F.lit(int(min(1.0, per_language / r["count"]) * (1 << 30)))) for r in counts))
    drawn = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(9)), F.lit(1 << 30)) < F.coalesce(share[F.col(lang_col)], F.lit(0)))
    rows = _vectors(drawn, text_col, lang_col).collect()
    return fit([(g, np.frombuffer(x, np.float32)) for g, x in sorted((r["lang"], bytes(r["x"])) for r in rows)])


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``(id, lang_pred, family_pred, score)`` for every row of ``docs`` from its text alone, learned from ``train``.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if ``train`` has no label. Very short
    texts are predicted like others, very long ones from all of their letters. Equal texts get equal answers; rows that repeat an id keep
    their own rows, null ids too; a tie goes to the first language by name. Other columns may have any name. An empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(learn(train, text_col, id_col=id_col, **more)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value)
        for batch in slices(batches, "t"):
            x = [features(t) for t in batch.column("t").to_pylist()]
            out = [(UNKNOWN, UNKNOWN, 0.0)] * len(x)
            at = [i for i, v in enumerate(x) if v is not None]
            if at and model is not None:
                for i, p in zip(at, model.predict(np.array([x[i] for i in at], np.float32))):
                    out[i] = p
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64())))], ["id", "lang_pred", "family_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, family_pred string, score double")
