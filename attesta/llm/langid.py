"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time on whole texts. It reads a
text's bytes (A-Z lower-cased) from the first to the last and from the last to the first, labels
every byte position, white space too, and pools: a document's probabilities are the mean of those of
all its positions. So that many texts go through it at once, a text is laid out in stretches, but
its state is never reset: each stretch is begun with the state that its neighbour ends with. That
state is first guessed from the bytes just before; where the neighbour turns out to end otherwise,
the stretch is read again, until all agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, crc_mod, documents_of, forget_others, parts

#: Unknown: null, or without letters.
UNDETERMINED = "und"
#: The remainder of crc32(doc_id) mod 4 that is held out of training.
FOLDS, HELD_OUT = 4, 2
#: The bounded sample that the network learns from: documents of a language, read whole, and bytes
#: of all these together (but one document of any size).
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 160, 600_000
#: Size of the network and of its training: bytes in a stretch, stretches in a batch, passes.
EMBEDDING, HIDDEN, SEED = 12, 16, 7
TRAIN_STRETCH, BATCH, EPOCHS, LEAST_STEPS, RATE = 64, 256, 2, 120, 0.02
#: Bytes that are read in one go, bytes that a state is guessed from, and how much of a state may
#: differ from the neighbour's. They set the work and the memory, not the labels.
STRETCH, CONTEXT, SETTLED = 768, 160, 1e-3
#: Stretches that go through the network together, and bytes of texts that are held at a time.
AT_ONCE, BYTES_AT_ONCE = 1024, 4_000_000
#: Below this probability a document counts as rejected by the filter.
LEAST_SCORE = 0.3
#: A document may have this much larger a share of unknown trigrams than 99 in 100 learned ones.
ALLOWANCE, MOST_UNSEEN = 1.5, 0.5


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), the network's bounded function: numpy takes a sixth of tanh's time for it."""
    size = np.abs(x)
    size += 1
    return np.divide(x, size, out=size)


def _slope(y: np.ndarray) -> np.ndarray:
    """Of ``_squash`` where its value is y."""
    return (1 - np.abs(y)) ** 2


def _softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


@dataclass
class ByteGru:
    """embedding (256, E); for each direction d: w (E, 3H), u (H, 3H), b (3H); out (2H, L), bias (L)."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], seed: int = SEED) -> "ByteGru":
        rng = np.random.default_rng(seed)
        e, h, n = EMBEDDING, HIDDEN, len(languages)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        weights = {"embedding": 0.5 * rng.standard_normal((256, e)).astype(np.float32), "out": draw(2 * h, n), "bias": np.zeros(n, np.float32)}
        for d in "fb":
            weights |= {f"w{d}": draw(e, 3 * h), f"u{d}": draw(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}
        return cls(languages, weights)

    def _run(self, codes: np.ndarray, mask: np.ndarray, d: str, keep: list) -> np.ndarray:
        """States (T, N, H) of one direction. codes, mask: (T, N). Where the mask is 0 the state stays."""
        w, h = self.weights, HIDDEN
        projected = (w["embedding"] @ w[f"w{d}"] + w[f"b{d}"])[codes]
        state, states = np.zeros((codes.shape[1], h), np.float32), np.empty((*codes.shape, h), projected.dtype)
        order = range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1)
        u_gates, u_new = w[f"u{d}"][:, : 2 * h], w[f"u{d}"][:, 2 * h :]
        for t in order:
            x, m = projected[t], mask[t][:, None]
            gates = 0.5 + 0.5 * _squash(x[:, : 2 * h] + state @ u_gates)
            update, reset = gates[:, :h], gates[:, h:]
            new = _squash(x[:, 2 * h :] + (reset * state) @ u_new)
            after = state + m * update * (new - state)
            keep.append((t, state, update, reset, new, m))
            state = after
            states[t] = state
        return states

    def gradients(self, codes: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions, and its gradients by backpropagation through time."""
        w, h = self.weights, HIDDEN
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self._run(codes, mask, d, kept[d]) for d in "fb"}
        both = np.concatenate((states["f"], states["b"]), axis=2)
        p = _softmax(both @ w["out"] + w["bias"])
        total, at = mask.sum(), (np.arange(codes.shape[0])[:, None], np.arange(codes.shape[1])[None, :], labels[None, :])
        loss = float(-(np.log(p[at] + 1e-9) * mask).sum() / total)
        p[at] -= 1
        p *= (mask / total)[:, :, None]
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["out"] = both.reshape(-1, 2 * h).T @ p.reshape(-1, p.shape[2])
        g["bias"] = p.sum(axis=(0, 1))
        d_both = p @ w["out"].T
        order = codes.ravel().argsort(kind="stable")
        present, first = np.unique(codes.ravel()[order], return_index=True)
        for i, d in enumerate("fb"):
            d_states, d_next = d_both[:, :, i * h : (i + 1) * h], np.zeros((codes.shape[1], h), np.float32)
            u_gates, u_new = w[f"u{d}"][:, : 2 * h], w[f"u{d}"][:, 2 * h :]
            d_inputs = np.empty((*codes.shape, 3 * h), d_both.dtype)
            for t, before, update, reset, new, m in reversed(kept[d]):
                d_state = d_next + d_states[t]
                d_new = d_state * m * update * _slope(new)
                d_update = d_state * m * (new - before) * 0.5 * _slope(2 * update - 1)
                d_mixed = d_new @ u_new.T
                d_reset = d_mixed * before * 0.5 * _slope(2 * reset - 1)
                d_gates = np.concatenate((d_update, d_reset), axis=1)
                d_next = d_state * (1 - m * update) + d_mixed * reset + d_gates @ u_gates.T
                g[f"u{d}"][:, : 2 * h] += before.T @ d_gates
                g[f"u{d}"][:, 2 * h :] += (reset * before).T @ d_new
                d_inputs[t, :, : 2 * h], d_inputs[t, :, 2 * h :] = d_gates, d_new
            by_code = np.zeros((256, 3 * h), d_inputs.dtype)
            by_code[present] = np.add.reduceat(d_inputs.reshape(-1, 3 * h)[order], first)
            g[f"w{d}"] = w["embedding"].T @ by_code
            g[f"b{d}"] = by_code.sum(axis=0)
            g["embedding"] += by_code @ w[f"w{d}"].T
        return loss, g

    def _read(self, codes: np.ndarray, active: list[int], state: np.ndarray, d: str, logits: np.ndarray | None) -> np.ndarray:
        """The states that stretches end with. codes: (T, N), the longest stretch first, of which
        ``active[t]`` have a byte t; ``logits`` (T, N, L) is given what this direction adds to it."""
        w, h = self.weights, HIDDEN
        inputs = w["embedding"] @ w[f"w{d}"] + w[f"b{d}"]
        # each gate by itself, so that all arrays are contiguous
        in_update, in_reset, in_new = (np.ascontiguousarray(inputs[:, i * h : (i + 1) * h]) for i in range(3))
        u_update, u_reset, u_new = (np.ascontiguousarray(w[f"u{d}"][:, i * h : (i + 1) * h]) for i in range(3))
        out = w["out"][:h] if d == "f" else w["out"][h:]
        state = state.copy()
        for t in range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1):
            n = active[t]
            now, s = codes[t, :n], state[:n]
            reset = s @ u_reset
            reset += in_reset.take(now, axis=0)
            reset = _squash(reset)
            reset += 1
            reset *= s
            new = reset @ u_new
            new *= 0.5
            new += in_new.take(now, axis=0)
            new = _squash(new)
            update = s @ u_update
            update += in_update.take(now, axis=0)
            update = _squash(update)
            update += 1
            new -= s
            new *= update
            new *= 0.5
            s += new
            if logits is not None:
                logits[t, :n] += s @ out
        return state

    def _read_stretches(self, stretches: list[bytes], states: dict[str, np.ndarray], label: bool) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """For each stretch: the sum of its positions' probabilities (if label), and the states that
        it ends with in each direction. ``states``: those that it begins with."""
        sums, ends = np.zeros((len(stretches), len(self.languages)), np.float32), {d: s.copy() for d, s in states.items()}
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        order = np.argsort(-sizes, kind="stable")
        for at in range(0, len(order), AT_ONCE):
            some = order[at : at + AT_ONCE]
            longest = int(sizes[some[0]])
            if not longest:
                break
            codes = np.frombuffer(b"".join(stretches[i].ljust(longest, b"\0") for i in some), np.uint8).reshape(-1, longest).T.copy()
            active = [int(x) for x in np.searchsorted(-sizes[some], -np.arange(1, longest + 1), "right")]
            logits = np.zeros((longest, len(some), len(self.languages)), np.float32) if label else None
            if label:
                logits += self.weights["bias"]
            for d in states:
                ends[d][some] = self._read(codes, active, states[d][some], d, logits)
            if label:
                for a in range(0, longest, 64):
                    p = _softmax(logits[a : a + 64])
                    p *= (np.arange(a, min(a + 64, longest))[:, None] < sizes[some])[:, :, None]
                    sums[some] += p.sum(axis=0)
        return sums, ends

    def label_runs(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each run of bytes: the sum of its positions' probabilities, and how many positions."""
        stretches, owner = [], []
        for i, run in enumerate(runs):
            for at in range(0, len(run), STRETCH):
                stretches.append(run[at : at + STRETCH])
                owner.append(i)
        owner_of, n = np.array(owner, np.int64), len(stretches)
        sums = np.zeros((len(runs), len(self.languages)), np.float64)
        sizes = np.array([len(r) for r in runs], np.float32)
        if not n:
            return sums, sizes
        inner = np.flatnonzero(owner_of[1:] == owner_of[:-1])  # stretches with a neighbour to the right
        begins = {d: np.zeros((n, HIDDEN), np.float32) for d in "fb"}
        if len(inner):
            guess = {"f": ([stretches[i][-CONTEXT:] for i in inner], inner + 1), "b": ([stretches[i + 1][:CONTEXT] for i in inner], inner)}
            for d, (context, at) in guess.items():
                begins[d][at] = self._read_stretches(context, {d: np.zeros((len(at), HIDDEN), np.float32)}, False)[1][d]
        found, ends = self._read_stretches(stretches, begins, True)
        while len(inner):
            off = {"f": inner[np.abs(ends["f"][inner] - begins["f"][inner + 1]).max(axis=1) > SETTLED] + 1, "b": inner[np.abs(ends["b"][inner + 1] - begins["b"][inner]).max(axis=1) > SETTLED]}
            again = np.union1d(off["f"], off["b"])
            if not len(again):
                break
            begins["f"][off["f"]], begins["b"][off["b"]] = ends["f"][off["f"] - 1], ends["b"][off["b"] + 1]
            found[again], fresh = self._read_stretches([stretches[i] for i in again], {d: begins[d][again] for d in "fb"}, True)
            for d in "fb":
                ends[d][again] = fresh[d]
        np.add.at(sums, owner_of, found)
        return sums, sizes


def train(samples: list[tuple[str, bytes]], epochs: int = EPOCHS, seed: int = SEED) -> ByteGru:
    """A network from (language, text) by Adam. All stretches of all texts are learned from; those
    of languages with less text are drawn more than once, so that all count alike."""
    languages = sorted({lang for lang, _ in samples})
    net = ByteGru.fresh(languages, seed)
    pools = [[r[i : i + TRAIN_STRETCH] for lang, r in samples if lang == name for i in range(0, len(r), TRAIN_STRETCH)] or [b" "] for name in languages]
    if len(languages) < 2:
        return net
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    share = max(1, BATCH // len(languages))
    steps = max(LEAST_STEPS, epochs * -(-max(map(len, pools)) // share))
    turns = [np.concatenate([rng.permutation(len(p)) for _ in range(-(-steps * share // len(p)))]) for p in pools]
    for step in range(1, steps + 1):
        chosen = [(y, pools[y][i]) for y, turn in enumerate(turns) for i in turn[(step - 1) * share : step * share]]
        labels = np.array([y for y, _ in chosen])
        longest = max(len(r) for _, r in chosen)
        codes, mask = np.zeros((longest, len(chosen)), np.uint8), np.zeros((longest, len(chosen)), np.float32)
        for j, (_, r) in enumerate(chosen):
            codes[: len(r), j] = np.frombuffer(r, np.uint8)
            mask[: len(r), j] = 1
        _, grads = net.gradients(codes, mask, labels)
        norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
        rate = RATE * min(1, 2 * (1 - (step - 1) / steps)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            net.weights[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return net


#: A-Z lower-cased, other ASCII but letters blanked.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


@dataclass
class KnownScript:
    """The byte trigrams of the learned texts, as 2 MB of bits, and the share of others that a
    document of a learned language has at most."""

    seen: np.ndarray
    most: float

    @staticmethod
    def trigrams(text: bytes) -> np.ndarray:
        """Those with a letter in the middle."""
        b = np.frombuffer(text.translate(_LETTERS), np.uint8).astype(np.int32)
        return (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[b[1:-1] != 32] if len(b) > 2 else np.zeros(0, np.int32)

    @classmethod
    def learn(cls, samples: list[tuple[str, bytes]]) -> "KnownScript":
        """The share is measured on each half of the texts with the trigrams of the other half."""
        halves = np.zeros((2, 1 << 24), np.bool_)
        grams = [cls.trigrams(text) for _, text in samples]
        for i, g in enumerate(grams):
            halves[i % 2][g] = True
        shares = sorted(float((~halves[1 - i % 2][g]).mean()) for i, g in enumerate(grams) if len(g) >= 100)
        usual = shares[int(0.99 * (len(shares) - 1))] if len(shares) > 1 else MOST_UNSEEN
        return cls(np.packbits(halves[0] | halves[1], bitorder="little"), min(MOST_UNSEEN, 0.05 + ALLOWANCE * usual))

    def knows(self, text: bytes) -> bool:
        """Whether a text has no more unknown trigrams than ``most``, and what chance adds to that
        in a short text (three standard deviations, of trigrams that overlap by threes)."""
        g = self.trigrams(text)
        unseen = int((self.seen[g >> 3] >> (g & 7).astype(np.uint8) & 1 == 0).sum())
        return unseen <= self.most * len(g) + 3 * (3 * len(g) * self.most * (1 - self.most)) ** 0.5


def training_sample(documents: DataFrame, per_language: int = SAMPLE_DOCUMENTS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, bytes]]:
    """Up to ``per_language`` whole texts of each language, drawn by a hash, of ``most_bytes``
    together (but one text at least); only from documents outside the held-out fold, with text and
    lang. Copies of a row are drawn once, so no repeated row or doc_id enlarges the sample."""
    known = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where((crc_mod("doc_id", FOLDS) != HELD_OUT) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().collect())
    drawn = None
    turn = F.xxhash64("doc_id", "text", F.lit(SEED))
    for lang, count in counts:
        # over-drawn, so that with chance there are enough
        chance = min(1.0, (1.2 * per_language + 40) / count)
        chosen = (F.col("lang") == lang) & (F.pmod(turn, F.lit(1_000_000)) < int(1_000_000 * chance))
        drawn = chosen if drawn is None else drawn | chosen
    if drawn is None:
        return []
    by_turn = Window.partitionBy("lang").orderBy("turn")
    rows = known.where(drawn).select("lang", "text", turn.alias("turn")).dropDuplicates(["lang", "turn"])
    rows = rows.withColumn("nth", F.row_number().over(by_turn)).withColumn("bytes", F.sum(F.octet_length("text")).over(by_turn))
    rows = rows.where((F.col("nth") == 1) | (F.col("nth") <= per_language) & (F.col("bytes") <= most_bytes))
    return [(r["lang"], bytes_of(r["text"])) for r in sorted(rows.select("lang", "text", "turn").collect(), key=lambda r: (r["lang"], r["turn"]))]


def pooled(net: ByteGru, texts: list[str | None], runs: list[bytes] | None = None) -> Iterator[tuple[str, float]]:
    """(language, probability) of each text: the mean over all positions. Of languages that are
    equal, the first by name."""
    runs = [bytes_of(t) for t in texts] if runs is None else runs
    some = [i for i, t in enumerate(texts) if net.languages and t is not None and any(map(str.isalpha, t))]
    found: dict[int, np.ndarray] = {}
    at = 0
    while at < len(some):
        until, size = at, 0
        while until < len(some) and (until == at or size + len(runs[some[until]]) <= BYTES_AT_ONCE):
            size += len(runs[some[until]])
            until += 1
        found.update(zip(some[at:until], net.label_runs([runs[i] for i in some[at:until]])[0]))
        at = until
    for i in range(len(texts)):
        p = found.get(i)
        if p is None:
            yield UNDETERMINED, 0.0
        else:
            best = int(p.argmax())
            yield net.languages[best], float(min(1.0, p[best] / p.sum()))


def identify(documents: DataFrame, net: ByteGru | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per document row.

    Unless a network is given, one is trained on a bounded sample of the documents outside the
    held-out fold. lang_pred is a learned language, of equal ones the first by name; ``und``, with
    score 0, if the text is null, empty or has no letters, or nothing could be learned. A text of
    any length is read whole. Repeated doc_ids are labelled row by row; a null doc_id is not held
    out and not learned from; extra columns are ignored; an empty table gives an empty one.
    """
    sent = documents.sparkSession.sparkContext.broadcast(net or train(training_sample(documents)))
    schema = "doc_id long, lang_pred string, score double"
    fields = arrow_schema(schema)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for part in parts(batches, 512):
            found = list(pooled(sent.value, part.column(1).to_pylist()))
            if found:
                yield arrow_batch([part.column(0), *zip(*found)], fields)

    held_out = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    rows = documents_of(documents).mapInArrow(label, schema)
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_identified(documents: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents, all columns, without those of undetermined language, of a score below
    ``least_score``, or written unlike every learned language: with more byte trigrams that no
    learned text has than ``KnownScript`` allows. Null, empty and letterless texts go; a text of any
    length is judged whole; repeated rows are judged alike; an empty table gives an empty one."""
    samples = training_sample(documents)
    sent = documents.sparkSession.sparkContext.broadcast((train(samples), KnownScript.learn(samples)))
    text_at = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        net, script = sent.value
        for part in parts(batches, 512):
            texts = part.column(text_at).to_pylist()
            runs = [bytes_of(t) for t in texts]
            found = pooled(net, texts, runs)
            yield part.filter(pa.array([lang != UNDETERMINED and score >= least_score and script.knows(run) for run, (lang, score) in zip(runs, found)], pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
