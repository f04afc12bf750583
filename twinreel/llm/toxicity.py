"""Toxicity by a gapped subsequence string kernel, Nyström landmarks and a linear SVM."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, text_batches, trim, worker_state

#: Subsequences of three letters within SPAN characters; each gap costs a factor of DECAY.
SPAN, DECAY = 6, 0.75
#: Kernel values below NEAR count as 0; words longer than WINDOW letters are read in windows.
NEAR, WINDOW = 0.4, 24
#: Stands before a word, so that subsequences know its beginning.
START = "^"
LANDMARKS = 72
#: Least log-likelihood ratio of a landmark.
EVIDENCE = 8
#: Landmarks are words, or beginnings of words of so many characters (START counts).
STEMS = range(5, 9)
#: A text speaks for a landmark if it has it, or has it at these shares of its words, in two words.
SHARES = (0.0, 0.006, 0.012)
#: Two landmarks are no more alike than this.
ALIKE = 0.75
#: Power of the kernel of two words in the kernel of two texts; words of a text are counted by PARTS.
POWER, PARTS = 4, 100
#: Level at which a text's map saturates.
FULL = 4.0
RIDGE = 0.1
#: Margins that scores are calibrated with come from models of the other folds.
FOLDS = 3
#: Bounds of the training sample: rows and characters (of whole texts).
TRAIN_ROWS, TRAIN_CHARS = 6000, 40_000_000
THRESHOLD = 0.3
#: Entries of a worker's memory of words; it starts anew beyond that.
MEMORY = 250_000
#: Words that are compared at once.
WORDS_AT_ONCE = 2048
#: A word is also read without each of its letters in turn, at this share of the kernel value.
DELETED = 0.97
_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_]\s+){2,}[^\W\d_](?!\S)")
_HINT = re.compile(r"\s[^\W\d_]\s+[^\W\d_]\s")
_OTHER = re.compile(r"[^\w\s]+|_+")
_ASCII_DROPPED = {c: None for c in range(128) if not (chr(c).isalnum() or chr(c).isspace())}


def words_of(text: str) -> list[str]:
    """Words as letters and digits of any script, without capitals, accents and signs; letters
    spelled one by one are read as one word."""
    if text.isascii():
        letters = text.lower().translate(_ASCII_DROPPED)
    else:
        letters = _OTHER.sub("", unicodedata.normalize("NFD", text).lower())
    if _HINT.search(letters):
        letters = _SPELLED.sub(lambda m: "".join(m[0].split()), letters)
    return letters.split()


def pieces_of(word: str) -> list[str]:
    """The word after START, or half-overlapping windows of a long one; nothing for less than three
    letters and for numbers."""
    if len(word) < 3 or word.isdigit():
        return []
    whole = START + word
    if len(word) <= WINDOW:
        return [whole]
    return [whole[i : i + WINDOW] for i in range(0, len(whole) - WINDOW // 2, WINDOW // 2)]


class Alphabet:
    """Numbers of characters: those of the landmarks first, from 1; others get the numbers after
    them anew for each batch, so that every two different characters stay different."""

    def __init__(self, words: list[str]):
        import numpy as np

        self.known = np.array(sorted({ord(c) for w in words for c in w}), dtype=np.uint32)

    def numbers(self, text: str):
        """An int64 number for each character of a text, and how many numbers there are."""
        import numpy as np

        codes, which = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_inverse=True)
        own = np.isin(codes, self.known)
        number = np.where(own, np.searchsorted(self.known, codes) + 1, len(self.known) + np.cumsum(~own)).astype(np.int64)
        return number[which], len(self.known) + int((~own).sum()) + 1


def triples(words: list[str], alphabet: Alphabet):
    """The base of the numbers of subsequences; then for words of each length: their places, and
    (numbers of subsequences, weight) by gaps. A subsequence abc has number (a * base + b) * base + c."""
    import numpy as np

    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    order = [(length, at) for length, at in by_length.items()]
    numbers, base = alphabet.numbers("".join(words[i] for _, at in order for i in at))
    out, start = [], 0
    for length, at in order:
        c = numbers[start : start + length * len(at)].reshape(-1, length)
        start += length * len(at)
        gaps = [(near, far) for near in range(1, SPAN - 1) for far in range(near + 1, min(SPAN, length))]
        out.append((np.array(at), [
            ((c[:, : length - far] * base + c[:, near : length - far + near]) * base + c[:, far:], DECAY ** (far - 2)) for near, far in gaps
        ]))
    return base, out


def features(words: list[str], alphabet: Alphabet):
    """Normalised kernel features of words: (word, subsequence, weight), sorted by word. Only
    subsequences of known characters have numbers that mean something; the rest are 0."""
    import numpy as np

    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not words:
        return none
    base, groups = triples(words, alphabet)
    keys, weights = [], []
    for at, parts in groups:
        for k, w in parts:
            keys.append((at[:, None] * base**3 + k).ravel())
            weights.append(np.full(k.size, w))
    if not keys:
        return none
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(inverse, np.concatenate(weights))
    row, sub = unique // base**3, unique % base**3
    norm = np.sqrt(np.bincount(row, value**2, minlength=len(words)))
    return row, cube(sub, base, len(alphabet.known) + 1), value / norm[row]


def cube(sub, base: int, side: int):
    """Numbers of subsequences to the base `side` of the known characters; 0 for all others."""
    import numpy as np

    a, b, c = sub // (base * base), sub // base % base, sub % base
    return np.where((a < side) & (b < side) & (c < side), (a * side + b) * side + c, 0)


class Kernel:
    """Kernel values of words to the landmarks, remembered by word.

    A word that is near enough to a landmark is also compared without each of its letters in
    turn, so a letter put into a short word costs little.
    """

    def __init__(self, landmarks: list[str], memory: int = MEMORY):
        import numpy as np

        self.memory = memory
        self.landmarks, self.alphabet = landmarks, Alphabet(landmarks)
        self.side = len(self.alphabet.known) + 1
        row, sub, value = features(landmarks, self.alphabet)
        self.matrix = np.zeros((self.side**3, len(landmarks)), dtype=np.float32)
        self.matrix[sub, row] = value
        self.most = self.matrix.max(axis=1, initial=0)
        self.near: dict = {}

    def bounds(self, words: list[str]):
        """For each word, no less than its greatest kernel value to any landmark. The norm of
        unmerged features is no greater than that of merged ones, so nothing is sorted here."""
        import numpy as np

        out = np.zeros(len(words), dtype=np.float32)
        if words:
            base, groups = triples(words, self.alphabet)
            for at, parts in groups:
                top = sum(np.float32(w) * self.most[cube(k, base, self.side)].sum(axis=1) for k, w in parts)
                out[at] = top / np.sqrt(sum(w * w * k.shape[1] for k, w in parts))
        return out

    def values(self, words: list[str]):
        """(place of the word, its kernel values) for words with a subsequence that counts."""
        import numpy as np

        row, sub, value = features(words, self.alphabet)
        if not len(row):
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)), np.float32)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        return row[starts], np.add.reduceat(value[:, None].astype(np.float32) * self.matrix[sub], starts, axis=0)

    def learn(self, words: list[str]) -> None:
        import numpy as np

        for low in range(0, len(words), WORDS_AT_ONCE):
            part = words[low : low + WORDS_AT_ONCE]
            rows, owner = [], []
            for i, w in enumerate(part):
                for piece in pieces_of(w):
                    rows.append(piece)
                    owner.append(i)
            self.near.update(dict.fromkeys(part))
            hopeful = np.flatnonzero(self.bounds(rows) >= NEAR - 1e-4)
            rows, owner = [rows[i] for i in hopeful], [owner[i] for i in hopeful]
            at, k = self.values(rows)
            close = np.flatnonzero(k.max(axis=1, initial=0) >= NEAR)
            found = [(owner[at[i]], k[i]) for i in close]
            shorter = [(w[:j] + w[j + 1 :], owner[at[i]]) for i in close if k[i].max() < DELETED for w in [rows[at[i]]] if len(w) > 4 for j in range(1, len(w))]
            for first in range(0, len(shorter), WORDS_AT_ONCE):
                some = shorter[first : first + WORDS_AT_ONCE]
                at, k = self.values([w for w, _ in some])
                found += [(some[j][1], DELETED * v) for j, v in zip(at.tolist(), k, strict=True) if v.max() >= NEAR]
            for i, v in found:
                had, v = self.near[part[i]], np.where(v >= NEAR, v, 0)
                self.near[part[i]] = v if had is None else np.maximum(had, v)

    def remember(self, words: set[str]) -> None:
        """Learn the words that are not known. Where they would be too many with the known ones,
        memory starts anew with all of these words, known ones too."""
        new = words - self.near.keys()
        if len(self.near) + len(new) > self.memory:
            self.near.clear()
            new = words
        self.learn(list(new))

    def summed(self, texts: list[str]):
        """A row for each text: the kernel of the text to each landmark, which is the mean over its
        words of the kernel of words to the power of POWER, times PARTS."""
        import numpy as np

        cut = [words_of(t) for t in texts]
        out = np.zeros((len(texts), len(self.landmarks)))
        self.remember({w for words in cut for w in words})
        for x, words in zip(out, cut, strict=True):
            hits = [h for h in map(self.near.get, words) if h is not None]
            if hits:
                x[:] = (np.stack(hits).astype(np.float64) ** POWER).sum(axis=0) * PARTS / len(words)
        return out


def choose_landmarks(texts: list[str], toxic: list[int]) -> list[str]:
    """Words and beginnings of words that toxic texts have far more often than the rest, or have a
    far greater share of, no two too alike. Only what two toxic texts have is counted in the rest."""
    import numpy as np

    n1 = sum(toxic)
    n0 = len(toxic) - n1

    def parts(text):  # what a text speaks for: (word or stem, which of SHARES)
        words = Counter(w for w in words_of(text) if 3 <= len(w) <= WINDOW and not w.isdigit())
        often, kinds = Counter(), Counter()
        for w, n in words.items():
            for x in {(START + w)[:k] for k in STEMS if k <= len(w)} | {START + w}:
                often[x] += n
                kinds[x] += 1
        size = words.total()
        return [(x, k) for x, n in often.items() for k, share in enumerate(SHARES) if not share or (n >= share * size and kinds[x] > 1)]

    single = dict(zip(texts, toxic, strict=True))  # copies of a text are one text
    bad = Counter(x for t, y in single.items() if y for x in parts(t))
    bad = Counter({x: n for x, n in bad.items() if n > 1})
    clean = Counter(x for t, y in single.items() if not y for x in parts(t) if x in bad)

    def strength(x):  # signed log-likelihood ratio against the label
        a, b = bad[x], clean[x]
        p = (a + b) / (n0 + n1)
        g = sum(v * np.log(v / (n * p)) for v, n in ((a, n1), (b, n0)) if v)
        return g if a * n0 > b * n1 else -g

    strongest: dict[str, float] = {}
    for x in bad:
        strongest[x[0]] = max(strongest.get(x[0], 0.0), strength(x))
    ranked = sorted(((g, x) for x, g in strongest.items() if g > EVIDENCE), key=lambda v: (-v[0], -len(v[1]), v[1]))
    chosen: list[str] = []
    for _, w in ranked[: LANDMARKS * 12]:
        row, sub, value = features([w, *chosen], Alphabet([w, *chosen]))
        mine = dict(zip(sub[row == 0].tolist(), value[row == 0], strict=True))
        alike = np.bincount(row, [mine.get(s, 0) * v for s, v in zip(sub.tolist(), value, strict=True)], minlength=len(chosen) + 1)[1:]
        if not len(alike) or alike.max() < ALIKE:
            chosen.append(w)
        if len(chosen) == LANDMARKS:
            break
    return chosen


def distorted(texts: list[str], kernel: Kernel) -> list[str]:
    """The texts with a letter inserted in each word that is a landmark (the place and the
    letter, another one of the landmarks' alphabet, follow from the word and its position), so
    that the fit tolerates such words."""
    out, letters = [], [chr(c) for c in kernel.alphabet.known if chr(c) != START]
    for text in texts:
        words = words_of(text)
        kernel.remember(set(words))
        for i, w in enumerate(words):
            near = kernel.near.get(w)
            if near is not None and near.max() > DELETED and len(w) > 3:
                at = 1 + (i * 7 + len(w)) % (len(w) - 2)
                words[i] = w[:at] + letters[(i * 5 + len(w)) % len(letters)] + w[at:]
        out.append(" ".join(words))
    return out


def nystrom_root(kernel: Kernel):
    """The inverse square root of the kernel of the landmarks, as texts of one word."""
    import numpy as np

    row, sub, value = features(kernel.landmarks, kernel.alphabet)
    dense = np.zeros((len(kernel.landmarks), kernel.side**3))
    dense[row, sub] = value
    gram = dense @ dense.T
    size, vectors = np.linalg.eigh(np.where(gram >= NEAR, gram, 0) ** POWER)
    return vectors @ np.diag(1 / np.sqrt(np.maximum(size, 1e-2))) @ vectors.T


def mapped(summed, root):
    """Nyström map of texts, scaled so that it saturates, and a constant. The scale depends on each
    text alone, so the product of two maps is a kernel still."""
    import numpy as np

    z = summed @ root
    return np.hstack([z / np.sqrt(FULL + (z**2).sum(axis=1, keepdims=True)), np.ones((len(z), 1))])


def svm(z, y):
    """Weights of least squared hinge loss: Newton steps over the texts inside the margin."""
    import numpy as np

    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-3
    for _ in range(50):
        active = y * (z @ w) < 1
        step = np.linalg.solve(np.diag(ridge) + z[active].T @ z[active], z[active].T @ y[active])
        if np.abs(step - w).max() < 1e-9:
            break
        w = step
    return w


def fit(texts: list[str], toxic: list[int]) -> dict:
    """A model: landmarks, Nyström root and weights, and the scale that turns margins into scores,
    which comes from the margins of texts under models that have not seen them."""
    import numpy as np

    base = (sum(toxic) + 1) / (len(toxic) + 2)
    landmarks = choose_landmarks(texts, toxic) if len(set(toxic)) == 2 else []
    if not landmarks:
        return {"landmarks": [], "base": base}
    kernel, own = Kernel(landmarks), len(texts)
    source = np.array([*range(own), *(i for i, y in enumerate(toxic) if y)])
    every = texts + distorted([t for t, y in zip(texts, toxic, strict=True) if y], kernel)
    x = np.vstack([kernel.summed(every[i : i + 256]) for i in range(0, len(every), 256)])
    root = nystrom_root(kernel)
    z, y = mapped(x, root), np.where(np.array(toxic)[source] == 1, 1.0, -1.0)
    margin, fold = np.zeros(own), np.zeros(own, np.int64)
    for label in (-1, 1):  # each fold has its share of either label
        at = np.flatnonzero(y[:own] == label)
        fold[at] = np.arange(len(at)) % FOLDS
    for k in range(FOLDS):
        margin[fold == k] = z[:own][fold == k] @ svm(z[fold[source] != k], y[fold[source] != k])
    n1 = sum(toxic)
    t, ab = np.where(y[:own] == 1, (n1 + 1) / (n1 + 2), 1 / (own - n1 + 2)), np.zeros(2)
    for _ in range(50):  # margins to probabilities
        g = np.c_[margin, np.ones(own)]
        p = 1 / (1 + np.exp(-np.clip(g @ ab, -30, 30)))
        ab = ab + np.linalg.solve(g.T @ (g * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), g.T @ (t - p) - 1e-3 * ab)
    weights = svm(z, y)
    del x, z, kernel, every
    trim()
    return {"landmarks": landmarks, "root": root.tolist(), "weights": weights.tolist(), "scale": ab.tolist(), "base": base}


def score(model: dict, texts: list[str], kernel: Kernel | None):
    import numpy as np

    if not model["landmarks"]:
        return np.full(len(texts), model["base"])
    margin = mapped(kernel.summed(texts), np.array(model["root"])) @ np.array(model["weights"])
    return 1 / (1 + np.exp(-np.clip(margin * model["scale"][0] + model["scale"][1], -30, 30)))


def held_out(doc_id):
    """Rows that are never learnt from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> tuple[list[str], list[int]]:
    """At most `rows` labelled texts outside the held-out part, in the order of a hash of the id; a
    text that would bring them beyond `chars` characters together is left out, shorter ones after
    it are not.

    Which rows they are is decided by ids and lengths; only their texts go to the driver.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    some = (
        usable.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").cast("int").alias("label"))
        .withColumn("draw", F.md5(F.col("labelled").cast("string"))).orderBy("draw", "labelled").limit(rows)
    )
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(some), F.col("doc_id") == F.col("labelled")
    )
    size = F.char_length("text")
    lengths = found.select("draw", "doc_id", size.alias("n"), F.xxhash64("text").alias("sum")).orderBy("draw", "doc_id", "n", "sum").limit(rows).collect()
    total, wanted = 0, []
    for r in lengths:
        if total + r["n"] > chars:
            continue
        total += r["n"]
        wanted.append((r["doc_id"], r["sum"]))
    if not wanted:
        return [], []
    chosen = docs.sparkSession.createDataFrame(list(dict.fromkeys(wanted)), "doc_id long, sum long")
    taken = found.withColumn("sum", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "sum"], "left_semi")
    known = {(r["doc_id"], r["sum"]): (r["text"], r["label"]) for r in taken.select("doc_id", "sum", "text", "label").toLocalIterator()}
    rows_ = [known[x] for x in wanted]
    return [t for t, _ in rows_], [y for _, y in rows_]


def scorer(model: dict, memory: int = MEMORY):
    """Function texts -> scores, for use on executors; the landmarks' kernel is kept in the worker."""
    name = f"kernel_{memory}_" + hashlib.md5(" ".join(model["landmarks"]).encode()).hexdigest()

    def scores(texts: list[str]):
        kernel = worker_state(name, lambda: Kernel(model["landmarks"], memory)) if model["landmarks"] else None
        return score(model, texts, kernel)

    return scores


def toxicity_filter(docs: DataFrame, known: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, memory: int = MEMORY) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns; nothing is joined.

    The model is fitted on labelled rows of `known` as in toxicity_scores; without labels of
    both kinds nothing can be judged and every row stays. Null texts are scored as empty.
    memory: words that a worker remembers; it changes time and memory, not rows.
    """
    text_batches(docs.sparkSession)
    model = fit(*training_sample(known, labels))
    if not model["landmarks"]:
        return docs
    scores = scorer(model, memory)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                values = scores([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(values < threshold))
        forget()  # the stages after this one share the workers

    return docs.mapInArrow(run, docs.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; one map over whole texts.

    The model is fitted on a bounded sample of labelled texts (TRAIN_ROWS, TRAIN_CHARS) outside
    the held-out part; only texts enter a score. Null texts are scored as empty. Without labels
    of both kinds every score is the smoothed share of toxic labels. A null id is not held out.
    Repeated rows are ordinary rows; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    scores = scorer(fit(*training_sample(docs, labels, rows)))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id").cast("long")).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                values = scores(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(values, pa.float64())], ["doc_id", "held_out", "score"])
        trim()

    out = base.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
