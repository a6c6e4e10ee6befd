"""LM scoring by online logistic context mixing.

A text is a sequence of words and one end, and is told bit by bit; each bit is predicted in several hashed contexts, whose predictions are
mixed in the logistic domain by gated weights and refined by a map.

- Segments: texts are cut at content-defined places, every 32 words or so. One bit says whether a segment continues its predecessor as the
  training texts do; if so, their counts tell which way. The table of segments is keyed, partitioned, and grows with the corpus.
- Classes: else each word's frequency class (six bits) is predicted from the classes of the two words before, from the last word itself where it is
  a common one and else from what ends it, and from the text's own classes so far.
- Choice: which word of its class it is tells its code, bit by bit, in the contexts of the class, the word before and the two words before. The code of
  a common word is its number in its class; that of another word begins with bits of its hash, and its number among the class's words with these bits follows.
- Repeats: the text so far tells a word, too, by its counts; one bit, predicted as well, chooses between the two.
  The bit isn't told: both ways count, so that a word which has stood before loses nothing. The table of words is keyed, too.
- Spelling: words that training texts haven't got are spelled, bits of bytes predicted by the word's last bytes and all of it so far.

Contexts are counted over all training texts, whole and by occurrence, in integers, and weights are fitted to these counts, so the
partitions of the input don't matter. Along a text the mixing weights and the text's own counts are updated after its words 16, 32, 64 and so on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, give_back, mix64, text_bytes, text_slices

#: Bytes of text of one block of documents, and tokens of it that are scored at once.
BLOCK_BYTES, TOKENS = 12 << 20, 1 << 15
#: A word begins a segment if this many lower bits of a hash of it and the word before are zero.
SEGMENT_BITS = 5
#: The spelling's contexts: the last bytes, so many of them, and the whole word so far; bits of the slot numbers of each. Spelling is for new words
#: only, and what is broadcast for it has this size whatever the corpus; contexts of a larger vocabulary share slots.
ORDERS, SLOT_BITS = (1, 2, 3, 4), (16, 17, 18, 19, 18)
OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])])
#: Slots of one row of a table.
PIECE = 1 << 16
#: Entries of words, segments and contexts that one bucket adds up, over all blocks.
ENTRIES = 1 << 20
#: Words that one group trains the spelling's weights on, in the order of their hashes.
GROUP = 1 << 15
#: Weight sets: by how often the word so far and the last bytes have been seen. Steps of the refining map, and its rows by place in the word.
WHOLE_STEPS, LAST_STEPS, MAP_STEPS, MAP_ROWS = 8, 3, 33, 8
INPUTS = len(SLOT_BITS) + 1
#: Classes: 0 for new words, 1 + log2 of the count for others; the end; what stands before a text.
END, START, CLASSES = 40, 41, 42
#: A class's words are common if each is at least one in so many training words: there are no more than that.
COMMON = 2048
#: How many words after a common one weigh as much as what the corpus has, where a word is told by the counts of pairs alone (as scores did before).
PAIR_PRIOR = 50.0
#: Which word of its class: hashed contexts (the class, and with it the word before, and the two before), bits of the slot numbers of each.
CHOICE_BITS = (18, 20, 20)
CHOICE_OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in CHOICE_BITS])])
#: States that a slot's counts are told as, and gates: what is known of the common word before, whether the word is common, the bit's place in the code.
CHOICE_STATES, CHOICE_GATES = (22, 29, 29), 32
CHOICE_EVENTS = CHOICE_GATES * int(np.prod(CHOICE_STATES))
#: Words of the corpus for one more bit of the hash that begins the code of a word that isn't common.
RANGE = 1 << 19
#: What a word that training texts lack is taken to be worth while repeats are learned.
NEW = 1e-6
#: Words after which a text's weights are updated for the first time; how far.
FIRST, RATE = 16, 0.05


def stretch(p):
    return np.log(p / (1 - p))


def squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Spelled:
    """Words in bytes, each with its end, and the context hashes of every byte."""

    def __init__(self, words: pa.Array):
        raw = words.cast(pa.large_binary())
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        length = np.diff(ends) + 1
        self.first = np.cumsum(length) - length
        n = int(length.sum())
        self.word = np.repeat(np.arange(len(length)), length)
        self.place = np.arange(n) - self.first[self.word]
        self.bytes = np.full(n, 32, np.uint8)
        self.bytes[self.place < (length - 1)[self.word]] = data
        before = np.zeros(n, np.uint64)
        self.contexts = []
        for k in range(1, max(ORDERS) + 1):
            there = self.place >= k
            byte = np.zeros(n, np.uint64)
            byte[k:] = self.bytes[:-k] if n > k else 0
            before = before + np.where(there, byte + np.uint64(1), np.uint64(0)) * np.uint64(257 ** (k - 1))
            if k in ORDERS:
                self.contexts.append(mix64(before + np.uint64(k << 56)))
        power = np.full(n, np.uint64(0x9E3779B97F4A7C15))
        if n:
            power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * power)])
        inverse = np.full(n, np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
        if n:
            inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        at = self.first[self.word]
        whole = (sums[np.arange(n)] - sums[at]) * inverse[at] if n else sums[:0]
        self.contexts.append(mix64(whole + self.place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    def bit(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Bit j of every byte, and the slot in each context's table."""
        value = ((self.bytes >> (7 - j)) & 1).astype(np.int64)
        node = (1 << j | self.bytes.astype(np.uint64) >> np.uint64(8 - j)).astype(np.uint64) if j else np.ones(len(self.bytes), np.uint64)
        slots = [(((c ^ node * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - b)).astype(np.int64) + o for c, b, o in zip(self.contexts, SLOT_BITS, OFFSETS)]
        return value, np.array(slots)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = np.zeros((2, OFFSETS[-1]), np.int32)  # slots where the bit was 0, then those where it was 1
    for batch in batches:
        for at in range(0, batch.num_rows, 50_000):
            spelled = Spelled(batch.column("word").slice(at, 50_000))
            for j in range(8):
                value, slots = spelled.bit(j)
                for k, slot in enumerate(slots):
                    for b in (0, 1):
                        tables[b, OFFSETS[k] : OFFSETS[k + 1]] += np.bincount(slot[value == b] - OFFSETS[k], minlength=1 << SLOT_BITS[k]).astype(np.int32)
    for b in (0, 1):
        for at in range(0, OFFSETS[-1], PIECE):
            if tables[b, at : at + PIECE].any():
                yield pa.RecordBatch.from_arrays([pa.array([int(b * OFFSETS[-1] + at)]), pa.array([tables[b, at : at + PIECE].tobytes()], pa.binary())], names=["at", "body"])


def _adding(key, tables):
    total = sum(np.frombuffer(b, np.int32).astype(np.int64) for b in tables.column("body").to_pylist())
    return pa.table({"at": [key[0].as_py()], "body": pa.array([np.minimum(total, (1 << 31) - 1).astype(np.int32).tobytes()], pa.binary())})


def predictions(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions and logarithms of how often a slot was seen, from counts [2, ...]; nothing seen predicts nothing."""
    n = seen[0] + seen[1]
    return (stretch((seen[1] + 0.2) / (n + 0.4)) * (n > 0)).astype(np.float32), np.log2(n + 1).astype(np.uint8)


class Mixer:
    """Gated weights and the refining map, trained online."""

    def __init__(self):
        self.weights = np.full((WHOLE_STEPS * LAST_STEPS, INPUTS), 0.3)
        self.map = np.tile(squash(np.linspace(-8, 8, MAP_STEPS)), (MAP_ROWS, 1))

    def state(self, stretched: np.ndarray, whole: np.ndarray, last: np.ndarray, place: np.ndarray):
        """What learn() needs, from the stretched predictions [contexts, bits] and how often the word so far and its last bytes were seen
        (logarithms)."""
        inputs = np.vstack([stretched, np.full((1, stretched.shape[1]), 0.3, np.float32)])
        gate = np.minimum(whole, WHOLE_STEPS - 1).astype(np.int64) * LAST_STEPS + np.minimum(last // 3, LAST_STEPS - 1)
        x = np.zeros(len(gate), np.float32)
        for k in range(INPUTS):
            x += self.weights[:, k].astype(np.float32)[gate] * inputs[k]
        at = np.clip((np.clip(x, -7.999, 7.999) + 8) / 16 * (MAP_STEPS - 1), 0, MAP_STEPS - 1.001)
        low = at.astype(np.int64)
        return inputs, gate, x, np.minimum(place, MAP_ROWS - 1), low, at - low

    def predict(self, stretched: np.ndarray, whole: np.ndarray, last: np.ndarray, place: np.ndarray):
        """Probability of a one, and the state() that it comes from."""
        state = self.state(stretched, whole, last, place)
        _, _, x, row, low, part = state
        refined = self.map[row, low] * (1 - part) + self.map[row, low + 1] * part
        return np.clip((squash(x) + refined) / 2, 1e-6, 1 - 1e-6), state

    def learn(self, value: np.ndarray, weight: np.ndarray, state, rate: float) -> None:
        inputs, gate, x, row, low, part = state
        miss = (value - squash(x)) * weight
        mass = np.maximum(np.bincount(gate, weight, len(self.weights)), 1e-9)
        for k in range(INPUTS):
            self.weights[:, k] += rate * np.bincount(gate, miss * inputs[k], len(self.weights)) / mass
        near = low + (part >= 0.5)
        flat = row * MAP_STEPS + near
        total, ones = np.bincount(flat, weight, self.map.size), np.bincount(flat, weight * value, self.map.size)
        fresh = self.map.ravel()
        self.map = np.where(total > 0, fresh + (ones - total * fresh) / (total + 200), fresh).reshape(self.map.shape)


def without(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """predictions() of all slots less one bit, and then [bit, slot]: a word is left out of what predicts it, as spelling is for words that the
    corpus hasn't shown."""
    less = [np.stack([np.maximum(seen[b] - (b == bit), 0) for b in (0, 1)]).astype(float) for bit in (0, 1)]
    stretched, often = zip(*map(predictions, less))
    return np.stack(stretched), np.stack(often)


def _training(tables):
    left = []  # the same for all groups of a task

    def run(key, group):
        if not left:
            left.extend(x.ravel() for x in without(tables.value))
        mixer, words = Mixer(), group.sort_by("h").column("word").combine_chunks()
        for at in range(0, len(words), 1_000):
            spelled = Spelled(words.slice(at, 1_000))
            some = np.ones(len(spelled.bytes))
            for j in range(8):
                value, slots = spelled.bit(j)
                slots += value * OFFSETS[-1]
                mixer.learn(value, some, mixer.state(left[0][slots], left[1][slots[-1]], left[1][slots[-2]], spelled.place), 0.1)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "words": pa.array([len(words)], pa.int64()), "weights": pa.array([mixer.weights.tobytes()], pa.binary()), "map": pa.array([mixer.map.tobytes()], pa.binary())})

    return run


def fitted(training: DataFrame, tables) -> tuple[Mixer, int]:
    """The mixer that all training words train, and how many words these were. Words are dealt to groups by their hash; a group is one online
    pass in the order of the hashes, and the mean of all groups is taken in their order, so that partitions make no difference."""
    mixer = Mixer()
    groups = max(1, -(-training.count() // GROUP))
    hashed = training.select("word", F.xxhash64("word").alias("h")).withColumn("g", F.pmod("h", F.lit(groups)))
    trained = sorted(hashed.groupBy("g").applyInArrow(_training(tables), "g long, words long, weights binary, map binary").collect())
    mass = [r.words for r in trained]
    if trained:
        mixer.weights = np.average([np.frombuffer(r.weights).reshape(mixer.weights.shape) for r in trained], axis=0, weights=mass)
        mixer.map = np.average([np.frombuffer(r.map).reshape(mixer.map.shape) for r in trained], axis=0, weights=mass)
    return mixer, sum(mass)


def word_scores(words: pa.Array, stretched: np.ndarray, often: np.ndarray, mixer: Mixer) -> np.ndarray:
    """log10 probability of each word and its end, from predictions() of the whole tables."""
    spelled = Spelled(words)
    total = np.zeros(len(spelled.bytes))
    for j in range(8):
        value, slots = spelled.bit(j)
        p, _ = mixer.predict(stretched[slots], often[slots[-1]], often[slots[-2]], spelled.place)
        total += np.log10(np.where(value == 1, p, 1 - p))
    return np.bincount(spelled.word, total, len(words))


# --- blocks of documents


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    data, ends = text_bytes(words.cast(pa.large_string()))
    if not len(words):
        return np.zeros(0, np.uint64)
    return run_hashes(data.astype(np.uint64) + np.uint64(1), ends[:-1])


def run_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each run of values; a run ends where the next one starts."""
    r, inverse = np.full(len(values), np.uint64(0x9E3779B97F4A7C15)), np.full(len(values), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
    r[:1] = inverse[:1] = 1
    np.multiply.accumulate(r, out=r)
    np.multiply.accumulate(inverse, out=inverse)
    inverse = inverse[starts]
    r *= values
    return mix64(np.add.reduceat(r, starts) * inverse)


def segments(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where segments of words begin, and the hashes of the segment before (0 for a text's first) and of each segment."""
    n = int(ends[-1])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    begins = np.zeros(n, bool)
    begins[1:] = (mix64(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]) & np.uint64((1 << SEGMENT_BITS) - 1)) == 0
    first = ends[:-1][np.diff(ends) > 0]
    begins[first] = True
    starts = np.flatnonzero(begins)
    own = run_hashes(h, starts)
    before = np.concatenate([np.zeros(1, np.uint64), own[:-1]])
    before[np.searchsorted(starts, first)] = 0
    return starts, before, own


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = 0
    for batch in text_slices(batches, "text", BLOCK_BYTES, rows=4096):
        words = pc.ascii_split_whitespace(batch.column("text"))
        # lowered after the split: of a slice that doesn't begin at byte 0, ascii_lower keeps the offsets but not the bytes before
        flat, count = pc.ascii_lower(words.flatten()), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        del words  # what has an item a word goes as soon as it can: a worker stands beside others
        length, cuts = pc.binary_length(flat).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(count)])
        full = length > 0  # text that begins or ends with white space
        ends = np.concatenate([[0], np.cumsum(full)])[cuts]
        size = np.diff(np.concatenate([[0], np.cumsum(length, dtype=np.int64)])[cuts]) + np.diff(ends) + 1
        del length
        flat = flat.filter(pa.array(full))
        del full
        coded = flat.dictionary_encode()
        del flat
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        often = np.argsort(-np.bincount(at, minlength=len(coded.dictionary)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(often), np.int32)
        rank[often] = np.arange(len(often))
        at, vocab = rank[at], coded.dictionary.take(pa.array(often))
        del coded
        held = batch.column("held_out").to_numpy(zero_copy_only=False)
        learned = np.bincount(at[~np.repeat(held, np.diff(ends))], minlength=len(vocab))
        h = hashed(vocab)
        starts, before, own = segments(h[at] if len(at) else h, ends)
        row = np.searchsorted(ends, starts, "right") - 1
        ways, index, pair = np.unique(mix64(before) + own, return_index=True, return_inverse=True)
        contexts, context = np.unique(before[index], return_inverse=True)
        taught = np.bincount(pair[~held[row]], minlength=len(index))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), one(batch.column("doc_id")), one(pa.array(held)), one(pa.array(np.diff(ends).astype(np.int32))), one(pa.array(size)),
                pa.array([at.tobytes()], pa.binary()), one(vocab.cast(pa.string())), one(pa.array(learned.astype(np.int64))),
                pa.array([np.diff(starts, append=len(at)).astype(np.int32).tobytes()], pa.binary()), pa.array([pair.astype(np.int32).tobytes()], pa.binary()),
                pa.array([np.concatenate([h, ways, mix64(contexts ^ np.uint64(0xA0761D6478BD642F))]).tobytes()], pa.binary()),
                pa.array([np.concatenate([learned, taught, np.bincount(context, taught, len(contexts))]).astype(np.int64).tobytes()], pa.binary()), pa.array([context.astype(np.int32).tobytes()], pa.binary()),
            ],
            names=["number", "keys", "held", "counts", "sizes", "at", "vocab", "learned", "lengths", "pairs", "entries", "taught", "contexts"],
        )
        number += 1
        del batch, size, at, vocab, held, learned, pair  # before the next slice comes


def one(values: pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


BLOCK = "number long, keys array<long>, held array<boolean>, counts array<int>, sizes array<long>, at binary, vocab binary, lengths binary, pairs binary, entries binary, taught binary, contexts binary, n_entries long, n_words long"
JOINED = "keys array<long>, held array<boolean>, counts array<int>, sizes array<long>, at binary, lengths binary, pairs binary, c binary, stops binary, new binary, pair_n binary, context_n binary, tops binary, codes binary, fresh array<string>, fresh_c array<long>"


def squeezed(values: np.ndarray) -> bytes:
    """Numbers compressed byte plane by byte plane."""
    return zstandard.ZstdCompressor(level=3).compress(np.frombuffer(values.tobytes(), np.uint8).reshape(-1, values.itemsize).T.tobytes())


def restored(body: bytes, kind=np.int32) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(body), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their numbers and words compressed."""
    for b in _blocks(batches):
        raw = {name: b.column(name)[0].as_py() for name in ("at", "pairs", "entries", "taught", "contexts")}
        packed = {name: squeezed(np.frombuffer(x, np.int64 if name == "taught" else np.int32)) for name, x in raw.items() if name != "entries"} | {"entries": raw["entries"]}
        words = zstandard.ZstdCompressor(level=3).compress(pc.binary_join(b.column("vocab"), "\n")[0].as_buffer())  # words hold no white space
        packed |= {"vocab": words, "lengths": b.column("lengths")[0].as_py()}
        names = ["number", "keys", "held", "counts", "sizes", "at", "vocab", "lengths", "pairs", "entries", "taught", "contexts"]
        yield pa.RecordBatch.from_arrays([*[pa.array([packed[n]], pa.binary()) if n in packed else b.column(n) for n in names], pa.array([len(raw["entries"]) // 8], pa.int64()), pa.array([len(b.column("vocab")[0])], pa.int64())], names=[*names, "n_entries", "n_words"])


# --- totals of words, segments and contexts: each block has an entry once, with how often its training texts have it, and gets the corpus's total


def leading(entries: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of each hash."""
    return (entries >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(entries), np.int64)


def dealt(entries: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries bucket by bucket, and where each bucket begins and the last one ends. A bucket has the hashes that begin alike."""
    bucket = leading(entries, bits)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange((1 << bits) + 1))


def numbered(group: np.ndarray) -> np.ndarray:
    """Of each item a one, then its number among those of its group, in as many bits as the group's last number has."""
    before, every = earlier(group)
    return (1 << np.frexp((every - 1).astype(float))[1]) | before


def _parcels(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                entries, taught = np.frombuffer(batch.column("entries")[i].as_py(), np.uint64), restored(batch.column("taught")[i].as_py(), np.int64)
                order, ends = dealt(entries, bits)
                there = np.flatnonzero(np.diff(ends))
                parts = [order[ends[k] : ends[k + 1]] for k in there]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(there), pa.array([batch.column("block")[i].as_py()] * len(parts), pa.int64()), pa.array([entries[p].tobytes() for p in parts], pa.binary()), pa.array([squeezed(taught[p]) for p in parts], pa.binary()), pa.array([np.searchsorted(p, batch.column("n_words")[i].as_py()) for p in parts], pa.int64())],
                    names=["bucket", "block", "entries", "taught", "words"],  # an entry's number says whether it is a word: these come first
                )
            give_back()

    return run


def _totals(ranges: int, least: int):
    """For each parcel of a bucket what other blocks have, which entries this block is the first one to teach, and the numbers of its words among
    those of their class whose hashes begin with the same `ranges` bits (common words have theirs from the list of common words)."""

    def run(key, group):
        group = group.sort_by("block")
        sizes = np.array([len(x) // 8 for x in group.column("entries").to_pylist()])
        entries = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("entries").to_pylist()])
        taught = np.concatenate([restored(x, np.int64) for x in group.column("taught").to_pylist()])
        begins = np.cumsum(sizes) - sizes
        word = np.arange(len(entries)) - np.repeat(begins, sizes) < np.repeat(group.column("words").to_numpy(), sizes)
        every, which = np.unique(entries, return_inverse=True)
        total = np.bincount(which, taught).astype(np.int64)  # exact below 2^53
        some = np.flatnonzero(taught)
        first = np.zeros(len(entries), np.uint8)
        first[some[np.unique(which[some], return_index=True)[1]]] = 1
        rare = np.zeros(len(every), bool)
        rare[which[word]] = True
        rare = np.flatnonzero(rare & (total > 0) & (total < least))
        number = np.zeros(len(every), np.int64)
        number[rare] = numbered(leading(every[rare], ranges) * CLASSES + log2s(total[rare], END - 1))
        cuts = begins[1:]
        rest, numbers = ([squeezed(x) for x in np.split(v, cuts)] for v in (total[which] - taught, number[which]))
        return pa.table({"block": group.column("block"), "bucket": pa.array([key[0].as_py()] * len(sizes), pa.int64()), "rest": pa.array(rest, pa.binary()), "first": pa.array([squeezed(x) for x in np.split(first, cuts)], pa.binary()), "numbers": pa.array(numbers, pa.binary())})

    return run


def _joined(bits: int, ranges: int, least: int):
    """Blocks with the totals of their words, segments and contexts; words that training texts lack are kept, the hashes of
    those that they have at least `least` times, the codes of the others, and the words that a block is the first to teach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                entries, taught = np.frombuffer(batch.column("entries")[i].as_py(), np.uint64), restored(batch.column("taught")[i].as_py(), np.int64)
                total, first, number = taught.copy(), np.zeros(len(taught), bool), np.zeros(len(taught), np.int64)
                order, ends = dealt(entries, bits)
                for got in batch.column("totals")[i].as_py() or ():
                    mine = order[ends[got["bucket"]] : ends[got["bucket"] + 1]]
                    total[mine] += restored(got["rest"], np.int64)
                    first[mine] = restored(got["first"], np.uint8) > 0
                    number[mine] = restored(got["numbers"], np.int64)
                pairs, context = restored(batch.column("pairs")[i].as_py()), restored(batch.column("contexts")[i].as_py())
                text = zstandard.decompress(batch.column("vocab")[i].as_py())
                words = pa.array(text.decode().split("\n") if text else [], pa.string())
                v, ways = len(words), len(context)
                c = total[:v]
                # a one, the hash's first bits, and the number behind its own first one
                digits = np.maximum(np.frexp(number[:v].astype(float))[1] - 1, 0)
                codes = np.where(number[:v] > 0, ((1 << ranges) | leading(entries[:v], ranges)) << digits | number[:v] - (1 << digits), 0)
                stops = pc.match_substring_regex(words, "[.!?;:,]$").to_numpy(zero_copy_only=False).astype(np.uint8)
                new = "\n".join(words.filter(pa.array(c == 0)).to_pylist()).encode()
                here = [pa.array([x], pa.binary()) for x in (squeezed(c), squeezed(stops), zstandard.ZstdCompressor(level=3).compress(new), squeezed(total[v : v + ways]), squeezed(total[v + ways :][context]), entries[:v][c >= least].tobytes(), squeezed(codes))]
                same = [batch.column(n).slice(i, 1) for n in ("keys", "held", "counts", "sizes", "at", "lengths", "pairs")]
                yield pa.RecordBatch.from_arrays([*same, *here, one(words.filter(pa.array(first[:v]))), one(pa.array(c[first[:v]]))], names=[x.split()[0] for x in JOINED.split(", ")])
                del entries, taught, total, order, words
            give_back()

    return run


# --- bits of a text


def log2s(x: np.ndarray, most: int) -> np.ndarray:
    """0 for 0, else 1 + log2, rounded down; at most most."""
    return np.minimum(np.frexp(x.astype(float))[1], most)


def earlier(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item how many equal ones stand before it, and how many there are in all."""
    order = np.argsort(group, kind="stable")
    begins = np.flatnonzero(np.diff(group[order], prepend=-1))
    size = np.diff(np.append(begins, len(group)))
    before, every = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    before[order] = np.arange(len(group)) - np.repeat(begins, size)
    every[order] = np.repeat(size, size)
    return before, every


class Common:
    """The common words: their hashes, counts and classes, in the order of the hashes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, least: int):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.least = hashes[order], counts[order], least
        self.classes = np.append(log2s(self.counts, END - 1), -1)  # the last one for words that aren't common
        self.numbers = numbered(self.classes[:-1])  # a one and the word's number in its class: no class has common words and others

    def __len__(self) -> int:
        return len(self.hashes)

    @property
    def codes(self) -> int:
        """Codes of a word before: the common words, then class and stop of others."""
        return len(self) + 2 * CLASSES

    @property
    def sizes(self) -> tuple[int, ...]:
        """How many counts there are of classes, repeats, segments and pairs."""
        return 2 * CLASSES**2 * self.codes, 2 * REPEAT_EVENTS, 2 * SEGMENT_EVENTS, len(self) ** 2


class Texts:
    """Documents of a block, word by word: what the bits of their segments, classes and repeats are, and in which contexts they stand."""

    def __init__(self, batch: pa.RecordBatch, i: int, first: int, last: int, ends: np.ndarray, at: np.ndarray, c: np.ndarray, stops: np.ndarray, tops: np.ndarray, codes: np.ndarray, lengths, pairs, pair_n, context_n, starts, documents: int):
        held = batch.column("held")[i].values.to_numpy(zero_copy_only=False)[first:last]
        self.texts = last - first
        self.ends = ends[first : last + 1] - ends[first]
        self.at = at[ends[first] : ends[last]]
        n = len(self.at)
        self.text = np.repeat(np.arange(self.texts), np.diff(self.ends))
        self.place = np.arange(n) - self.ends[:-1][self.text]
        self.before, self.every = earlier(self.text.astype(np.int64) << 32 | self.at)
        self.c = c[self.at]
        self.known = log2s(self.c, END - 1)
        learning = ~held[self.text]
        # as the text's class would be without the text
        self.apart = np.where(learning, log2s(np.maximum(self.c - self.every, 0), END - 1), self.known)
        self.stop, self.top, self.code = stops[self.at], tops[self.at], codes[self.at]
        # segments
        a, b = np.searchsorted(starts, [ends[first], ends[last]])
        self.length, pair = lengths[a:b], pairs[a:b]
        self.start = starts[a:b] - ends[first]
        self.segment_text = self.text[self.start] if b > a else np.zeros(0, np.int64)
        opening = self.place[self.start] == 0 if b > a else np.zeros(0, bool)
        told_before, told = earlier(self.segment_text.astype(np.int64) << 32 | pair)
        mine = ~held[self.segment_text]
        self.ways = pair_n[pair] - told * mine + told_before
        # what the context has had: all of it elsewhere, and this text's own segments before; a text's first segment follows no other
        whole = np.where(opening, documents - mine, context_n[pair] - told * mine + told_before)
        self.seen = np.maximum(whole, self.ways)
        self.follows = self.ways > 0
        self.known_flag = np.zeros(len(pair), np.int64)
        if len(pair) > 1:
            same = self.segment_text[1:] == self.segment_text[:-1]
            self.known_flag[1:] = np.where(same, 1 + self.follows[:-1], 0)
        self.segment_place = np.arange(len(pair)) - np.searchsorted(self.segment_text, self.segment_text)
        self.spelled = ~np.repeat(self.follows, self.length) if len(pair) else np.zeros(n, bool)

    def with_ends(self, values: np.ndarray, end) -> np.ndarray:
        """Values of words with one of the end put in after each text."""
        return np.insert(values, self.ends[1:], end)

    def class_contexts(self, classes: np.ndarray, common: Common) -> tuple[np.ndarray, ...]:
        """Of every token: class, the two before, the code of the word before, text, place, and whether it is told (not in a segment that follows)."""
        cls, text = self.with_ends(classes, END), np.repeat(np.arange(self.texts), np.diff(self.ends) + 1)
        place = np.arange(len(cls)) - (self.ends[:-1] + np.arange(self.texts))[text]
        one, two, stop = (np.roll(x, k) for x, k in ((cls, 1), (cls, 2), (self.with_ends(self.stop, 0), 1)))
        one, two, stop = np.where(place < 1, START, one), np.where(place < 2, START, two), np.where(place < 1, 0, stop)
        top = np.where(place < 1, -1, np.roll(self.with_ends(self.top, -1), 1))
        # a word whose class without this text is another one doesn't count as common
        code = np.where((top >= 0) & (common.classes[top] == one), top, len(common) + one * 2 + stop)
        return *(x.astype(np.int32) for x in (cls, one, two, code, text, place)), self.with_ends(self.spelled, True)

    def after_common(self) -> tuple[np.ndarray, np.ndarray]:
        """The common words that follow a common one of their text, both told: their places, and what they follow."""
        there = self.spelled & (self.top >= 0)
        mine = np.flatnonzero(there[1:] & there[:-1] & (self.place[1:] > 0)) + 1
        return mine, self.top[mine - 1]

    def choices(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every bit that says which word of its class a told word is: the word, the bit's place in its code, the bit, and the slots in the
        contexts' tables. Bit after bit; new words have none."""
        names = mix64(self.code.astype(np.uint64) << np.uint64(6) | self.known.astype(np.uint64))
        one, two = (np.where(self.place < k, np.uint64(1), np.roll(names, k)) for k in (1, 2))
        mine = np.flatnonzero(self.spelled & (self.code > 1))
        known = self.known[mine].astype(np.uint64)
        after = one[mine] * np.uint64(0xD6E8FEB86659FD93) + known
        # 32 bits from here on; a node is a code's first bits and their number, which also differ where codes are longer
        contexts = [(mix64(x) >> np.uint64(32)).astype(np.uint32) for x in (known, after, after + mix64(two[mine]))]
        code, depth = self.code[mine], (np.frexp(self.code[mine].astype(float))[1] - 1).astype(np.int8)
        most = int(depth.max(initial=0))
        word, place, bit, slots = [mine[:0]], [mine[:0].astype(np.int8)], [mine[:0].astype(np.int8)], [np.zeros((len(CHOICE_BITS), 0), np.int32)]
        some = np.arange(len(mine))
        for j in range(most):
            if (depth[some] <= j).any():
                some = some[depth[some] > j]
            node = code[some] >> (depth[some] - j - 1)
            word.append(mine[some])
            place.append(np.full(len(some), j, np.int8))
            bit.append((node & 1).astype(np.int8))
            node = ((node >> 1).astype(np.uint32) + np.uint32(j)) * np.uint32(0xC2B2AE3D)
            at = np.empty((len(CHOICE_BITS), len(some)), np.int32)
            for k, (c, b, o) in enumerate(zip(contexts, CHOICE_BITS, CHOICE_OFFSETS)):
                at[k] = ((c[some] ^ node) * np.uint32(0x9E3779B1)) >> np.uint32(32 - b)
                at[k] += o
            slots.append(at)
        return np.concatenate(word), np.concatenate(place), np.concatenate(bit), np.concatenate(slots, axis=1)

    def choice_gates(self, word: np.ndarray, place: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The gate of each of these bits. after: how many words of each class follow each common word."""
        known = np.zeros(len(self.at), np.int64)
        mine = np.flatnonzero((self.place[1:] > 0) & (self.top[:-1] >= 0)) + 1
        known[mine] = 1 + np.minimum(log2s(after[self.top[mine - 1], self.known[mine]], 12) // 5, 2)
        return (known * 8 + (self.top < 0) * 4).astype(np.int32).take(word) + np.minimum(place // 3, 3)

    def share(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every word: its share in the words of its class that stand before it in the text, and how many these are."""
        of_class, _ = earlier(self.text.astype(np.int64) << 32 | classes)
        return self.before / np.maximum(of_class, 1), of_class

    def repeat_contexts(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every word: whether the word before is a repeat, and a step of its place."""
        again = self.before > 0
        return np.where(self.place > 0, np.roll(again, 1), 0).astype(np.int64), log2s(self.place, 15)


class Bits:
    """One kind of bits: counts in each context, weights by gate, the refining map. counts: [fold, bit, event] of training events, at: the
    places of each event in the contexts' tables, gate: its weight set."""

    def __init__(self, at: list[np.ndarray], gate: np.ndarray, counts: np.ndarray):
        self.gates = int(gate.max(initial=0)) + 1
        sizes = [int(x.max(initial=0)) + 1 for x in at]
        total = [[np.bincount(x, counts[f, b], n) for b in (0, 1)] for x, n in zip(at, sizes) for f in (0, 1)]
        total = np.array([[total[2 * k + f][b] for f in (0, 1) for b in (0, 1)] for k in range(len(at))], object)
        as_stretch = lambda zero, ones: np.where(zero + ones > 0, stretch((ones + 0.4) / (zero + ones + 0.8)), 0.0)
        self.tables = [as_stretch(t[0] + t[2], t[1] + t[3]).astype(np.float32) for t in total]
        # each half of the training texts is predicted by the other one's counts
        inputs = np.array([[as_stretch(t[2 * (1 - f)], t[2 * (1 - f) + 1])[x] for t, x in zip(total, at)] for f in (0, 1)])  # fold, context, event
        k = len(at)
        weights = np.full((self.gates, k), 1 / k)
        x, g = np.concatenate([inputs[0], inputs[1]], axis=1), np.concatenate([gate, gate])
        zero, ones = np.concatenate([counts[0, 0], counts[1, 0]]), np.concatenate([counts[0, 1], counts[1, 1]])
        some = zero + ones > 0
        x, g, zero, ones = x[:, some], g[some], zero[some], ones[some]
        for _ in range(8):  # Newton's steps, towards equal weights where there is little to learn from
            p = squash((weights[g].T * x).sum(axis=0))
            miss, curve = ones - (zero + ones) * p, (zero + ones) * p * (1 - p)
            slope = np.array([np.bincount(g, miss * x[i], self.gates) for i in range(k)]).T - 4.0 * (weights - 1 / k)
            bend = np.array([[np.bincount(g, curve * x[i] * x[j], self.gates) for j in range(k)] for i in range(k)]).transpose(2, 0, 1) + 4.0 * np.eye(k)
            weights = weights + np.clip(np.linalg.solve(bend, slope[:, :, None])[:, :, 0], -1, 1)
        self.weights = np.concatenate([weights, np.full((self.gates, 1), 0.05)], axis=1).astype(np.float32)
        step = self.step(weights[g].T * x)
        map_zero, map_ones = (np.bincount(step, v, MAP_STEPS) for v in (zero, ones))
        centre = squash(np.linspace(-8, 8, MAP_STEPS))
        self.map = ((map_ones + 50 * centre) / (map_zero + map_ones + 50)).astype(np.float32)

    def step(self, parts: np.ndarray) -> np.ndarray:
        return np.rint((np.clip(parts.sum(axis=0), -8, 8) + 8) / 16 * (MAP_STEPS - 1)).astype(np.int64)

    def follow(self, at: list[np.ndarray], gate: np.ndarray, bit: np.ndarray | None, text: np.ndarray, place: np.ndarray, texts: int, odds: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each bit, of many texts side by side. A text's weights and own counts change after its places FIRST, twice that and so on.

        With odds in place of bits nothing tells a bit: what follows it is so many times as likely after a one as after a zero, and the
        result is log10 of its probability, as a multiple of that after a zero. What is learned is then the bit's share in it."""
        out = np.zeros(len(gate))
        text = text.astype(np.int32)
        chunk = log2s(np.arange(place.max(initial=0) + 1) // FIRST, 60).astype(np.uint8).take(place)
        order = np.argsort(chunk, kind="stable")
        cuts = np.flatnonzero(np.diff(chunk[order], prepend=255, append=255))
        shift = np.zeros((texts, len(at) + 1), np.float32)
        own = np.zeros((2, texts * self.gates), np.float32)
        for a, b in zip(cuts, cuts[1:]):
            mine = order[a:b]
            t = text.take(mine)
            slot = t * self.gates + gate.take(mine)
            inputs = [table.take(x.take(mine)) for table, x in zip(self.tables, at)]
            inputs.append(np.log((own[1] + np.float32(0.4)) / (own[0] + np.float32(0.4))).take(slot))
            x = np.zeros(len(mine), np.float32)
            for k, v in enumerate(inputs):
                x += (self.weights[:, k] + shift[:, k, None]).ravel().take(slot) * v  # of each text and gate
            p = 1 / (1 + np.exp(-np.clip(x, -15, 15)))
            fine = np.clip((p + self.map.take(np.rint((np.clip(x, -8, 8) + 8) * ((MAP_STEPS - 1) / 16)).astype(np.int8))) / 2, 1e-6, 1 - 1e-6)
            if odds is None:
                value = bit.take(mine)
                out[mine] = np.log10(np.where(value, fine, 1 - fine))
            else:
                both = fine * odds[mine] + 1 - fine
                value = fine * odds[mine] / both
                out[mine] = np.log10(both)
            if b < len(order):  # there are later words
                miss = (value - p).astype(np.float32)
                mass = np.maximum(np.bincount(t, minlength=texts), 1)
                for k, v in enumerate(inputs):
                    shift[:, k] = np.clip(shift[:, k] + RATE * np.bincount(t, miss * v, texts) / mass, -1, 1)
                if odds is None:
                    own += np.bincount(slot * 2 + value, minlength=2 * texts * self.gates).reshape(-1, 2).T
                else:
                    own[0] += np.bincount(slot, 1 - value, minlength=texts * self.gates)
                    own[1] += np.bincount(slot, value, minlength=texts * self.gates)
        return out


#: Steps of how much likelier the text so far makes a word than the training texts do: never, then powers of two around 1.
RATIOS = 32
#: Places of the training counts of one fold.
REPEAT_EVENTS, SEGMENT_EVENTS = CLASSES * 2 * 16 * RATIOS, 8 * 3 * 2
#: The number of the first table of choices, which come after those of Common.sizes.
CHOICE_KIND = 4


def ratios(odds: np.ndarray) -> np.ndarray:
    """The step of each ratio."""
    with np.errstate(divide="ignore"):
        return np.where(odds > 0, np.clip(np.rint(np.log2(odds)) + RATIOS // 2, 1, RATIOS - 1), 0).astype(np.int64)


def shares(counts: np.ndarray) -> np.ndarray:
    """Of events by context and step of the ratio [..., RATIOS]: how many of a context's are due to zeros and to ones [2, ...], where ones
    have that share in each context which makes its events likeliest."""
    odds = np.where(np.arange(RATIOS) > 0, 2.0 ** (np.arange(RATIOS) - RATIOS // 2), 0)
    n = counts.sum(axis=-1)
    p = np.full(n.shape, 0.5)
    for _ in range(50):
        ones = (counts * (p[..., None] * odds / (p[..., None] * odds + 1 - p[..., None]))).sum(axis=-1)
        p = (ones + 0.05) / (n + 0.1)
    return np.array([n - ones, ones])


def states(zero: np.ndarray, ones: np.ndarray, alone: bool) -> np.ndarray:
    """Counts of slots as states: 0 for nothing seen. Those of the class alone are told by their share of ones, the others by how often they were seen, too."""
    n = zero + ones
    x = np.clip(stretch((ones + 0.4) / (n + 0.8)), -5, 5)
    if alone:
        return np.where(n > 0, 11 + np.rint(2 * x), 0).astype(np.uint8)
    share = ones / np.maximum(n, 1)
    steps = [(n == 1, 1 + share), (n == 2, 3 + 2 * share), (n <= 4, 6 + 3 * share), (n <= 12, 10 + 5 * share)]
    return np.select([n == 0, *(a for a, _ in steps)], [0, *(np.rint(b) for _, b in steps)], 22 + np.rint(x * 1.2)).astype(np.uint8)


def counted(x: Texts, fold: np.ndarray, learning: np.ndarray, mass: np.ndarray, common: Common) -> list[np.ndarray]:
    """The places of all events of the texts that are learned from, in tables of common.sizes and those of choices. mass: training tokens of each class."""
    cls, _, two, code, text, _, told = x.class_contexts(x.apart, common)
    use = told & learning[text]
    out = [(((fold[text] * CLASSES + two) * common.codes + code) * CLASSES + cls)[use]]
    previous, step = x.repeat_contexts(x.apart)
    here, of_class = x.share(x.apart)
    use = x.spelled & learning[x.text] & (of_class > 0)
    elsewhere = np.where(x.apart > 0, np.maximum(x.c - x.every, 1) / np.maximum(mass[x.apart], 1), NEW)
    out.append(((((x.apart * 2 + previous) * 16 + step) * RATIOS + ratios(here / elsewhere)) + fold[x.text] * REPEAT_EVENTS)[use])
    use = (x.seen > 0) & learning[x.segment_text] if len(x.seen) else np.zeros(0, bool)
    out.append((((np.maximum(log2s(x.seen, 8) - 1, 0) * 3 + x.known_flag) * 2 + x.follows) + fold[x.segment_text] * SEGMENT_EVENTS)[use])
    mine, first = x.after_common()
    use = learning[x.text[mine]]
    out.append((first * len(common) + x.top[mine])[use])
    word, _, bit, slots = x.choices()
    use = learning[x.text[word]]
    half = ((2 * fold).astype(np.int32)[x.text][word] + bit)[use]
    out += [slot[use] - o + (half << b) for slot, b, o in zip(slots, CHOICE_BITS, CHOICE_OFFSETS.tolist())]
    return out


def class_bits(cls, one_, two, code):
    """The six bits of each class: the contexts' places, the gate and the bit; bit after bit."""
    at, gates, bits = [[], [], [], []], [], []
    for j in range(6):
        node = (1 << j) | (cls >> (6 - j))
        gates.append(node)
        bits.append((cls >> (5 - j)) & 1)
        for k, context in enumerate((0, one_, two * CLASSES + one_, code)):
            at[k].append(context * 64 + node)
    return [np.concatenate(a) for a in at], np.concatenate(gates), np.concatenate(bits)


class Model:
    """Bits of classes, repeats and segments, fitted to counts of events."""

    def __init__(self, counts: list[np.ndarray], common: Common):
        self.common = common
        told = counts[0].reshape(2, CLASSES, common.codes, CLASSES)
        two, code, cls = np.nonzero(told.sum(axis=0))
        mass = told[:, two, code, cls]  # fold, event
        one_ = np.append(common.classes[:-1], np.repeat(np.arange(CLASSES), 2))[code]
        # every node of the class's code, so that each context has its place
        at, gate, bit = class_bits(cls, one_, two, code)
        every = np.concatenate([np.tile(mass, 6), np.zeros((2, 1))], axis=1)
        at, gate, bit = [np.append(x, top * 64 - 1) for x, top in zip(at, (1, CLASSES, CLASSES**2, common.codes))], np.append(gate, 63), np.append(bit, 0)
        self.classes = Bits(at, gate, np.array([[every[f] * (bit == b) for b in (0, 1)] for f in (0, 1)]))
        again = shares(counts[1].reshape(2, CLASSES, 2, 16, RATIOS))  # zero or one, fold, context
        c, p, s = (x.ravel() for x in np.meshgrid(np.arange(CLASSES), np.arange(2), np.arange(16), indexing="ij"))
        self.repeats = Bits(self.repeat_places(c, p, s), c, again[:, :, c, p, s].transpose(1, 0, 2))
        follow = counts[2].reshape(2, 8, 3, 2)
        n, f = (x.ravel() for x in np.meshgrid(np.arange(8), np.arange(3), indexing="ij"))
        self.follows = Bits(self.segment_places(n, f), f, follow[:, n, f].transpose(0, 2, 1).astype(float))

        # pairs of common words, and how many of each class follow each
        self.pairs = counts[3].reshape(len(common), len(common))
        self.after = np.array([np.bincount(common.classes[:-1], row, CLASSES) for row in self.pairs]).reshape(-1, CLASSES)

    def choose(self, counts: np.ndarray, tables: np.ndarray) -> None:
        """Fits the choice of a word. counts: [fold, bit, event], of gates and states; tables: states of all slots."""
        event = np.append(np.flatnonzero(counts.any(axis=(0, 1))), CHOICE_EVENTS - 1)
        gate, *seen = np.unravel_index(event, (CHOICE_GATES, *CHOICE_STATES))
        self.words, self.tables = Bits(self.choice_places(gate, seen), gate, counts[:, :, event].astype(float)), tables

    @staticmethod
    def choice_places(gate, seen):
        return [s.astype(np.int32) * CHOICE_GATES + gate for s in seen]

    @staticmethod
    def repeat_places(c, previous, step):
        return [c, c * 2 + previous, c * 16 + step]

    @staticmethod
    def segment_places(n, flag):
        return [n, flag, n * 3 + flag]

    def scores(self, x: Texts, logp: np.ndarray) -> np.ndarray:
        """log10 probability of each text. logp: of each word of the block as spelled."""
        cls, one_, two, code, text, place, told = x.class_contexts(x.known, self.common)
        mine = np.flatnonzero(told)
        at, gate, bit = class_bits(cls[mine], one_[mine], two[mine], code[mine])
        out = np.bincount(np.tile(text[mine], 6), self.classes.follow(at, gate, bit, np.tile(text[mine], 6), np.tile(place[mine], 6), x.texts), x.texts)
        # which word of its class: as the text so far has it, or as training texts (bit by bit) or the spelling do
        previous, step = x.repeat_contexts(x.known)
        here, of_class = x.share(x.known)
        word, nth, bit, slots = x.choices()
        gate = x.choice_gates(word, nth, self.after)
        chosen = self.words.follow(self.choice_places(gate, self.tables.take(slots)), gate, bit, x.text[word], x.place[word], x.texts)
        elsewhere = np.where(x.known > 0, np.bincount(word, chosen, len(x.at)), logp[x.at])
        mine = np.flatnonzero(x.spelled)
        out += np.bincount(x.text[mine], elsewhere[mine], x.texts)
        mine = np.flatnonzero(x.spelled & (of_class > 0))
        odds = here[mine] * 10.0 ** np.minimum(-elsewhere[mine], 250)
        out += np.bincount(x.text[mine], self.repeats.follow(self.repeat_places(x.known[mine], previous[mine], step[mine]), x.known[mine], None, x.text[mine], x.place[mine], x.texts, odds), x.texts)
        mine = np.flatnonzero(x.seen > 0)
        if len(mine):
            n = np.maximum(log2s(x.seen[mine], 8) - 1, 0)
            flags = self.follows.follow(self.segment_places(n, x.known_flag[mine]), x.known_flag[mine], x.follows[mine].astype(np.int64), x.segment_text[mine], x.segment_place[mine], x.texts)
            way = np.where(x.follows[mine], np.log10(np.maximum(x.ways[mine], 1) / x.seen[mine]), 0)
            out += np.bincount(x.segment_text[mine], flags + way, x.texts)
        return out


def _slices(batch: pa.RecordBatch, i: int, documents: int, common: Common) -> Iterator[tuple[int, int, Texts]]:
    """The texts of a block, TOKENS words at once or one longer text."""
    counts = batch.column("counts")[i].values.to_numpy()
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    lengths = np.frombuffer(batch.column("lengths")[i].as_py(), np.int32).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    at, pairs = (restored(batch.column(x)[i].as_py()) for x in ("at", "pairs"))
    c, pair_n, context_n = (restored(batch.column(x)[i].as_py(), np.int64) for x in ("c", "pair_n", "context_n"))
    stops = restored(batch.column("stops")[i].as_py(), np.uint8).astype(np.int64)
    tops, codes = np.full(len(c), -1), restored(batch.column("codes")[i].as_py(), np.int64).copy()
    tops[c >= common.least] = np.searchsorted(common.hashes, np.frombuffer(batch.column("tops")[i].as_py(), np.uint64))
    codes[c >= common.least] = common.numbers[tops[c >= common.least]]
    row = 0
    while row < len(counts):
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + TOKENS, "right")) - 1)
        yield row, to, Texts(batch, i, row, to, ends, at, c, stops, tops, codes, lengths, pairs, pair_n, context_n, starts, documents)
        row = to


class Tally:
    """Counts of how often each place of a table occurs. They are added up in place: tables are far larger than what a slice of texts has for them, and
    several stand side by side."""

    def __init__(self, size: int):
        self.counts = np.zeros(size, np.int32)

    def add(self, places: np.ndarray) -> None:
        np.add.at(self.counts, places, np.int32(1))


def _training_slices(batches: Iterator[pa.RecordBatch], documents: int, common: Common) -> Iterator[tuple[Texts, np.ndarray, np.ndarray]]:
    """The texts of all blocks, which half of the corpus each is of, and which are learned from."""
    for batch in batches:
        for i in range(batch.num_rows):
            learning = ~batch.column("held")[i].values.to_numpy(zero_copy_only=False)
            fold = pc.fill_null(batch.column("keys")[i].values, 0).to_numpy(zero_copy_only=False) & 1
            for first, last, x in _slices(batch, i, documents, common):
                yield x, fold[first:last], learning[first:last]
        give_back()


def _pieces(kind: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a table of counts [..., slots], PIECE slots each."""
    for at in range(0, counts.shape[-1], PIECE):
        if counts[..., at : at + PIECE].any():
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int64()), pa.array([at], pa.int64()), pa.array([squeezed(counts[..., at : at + PIECE])], pa.binary())], names=["kind", "at", "body"])


def _events(documents: int, mass: np.ndarray, common: Common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [Tally(n) for n in (*common.sizes, *(4 << b for b in CHOICE_BITS))]
        for x, fold, learning in _training_slices(batches, documents, common):
            for all_, some in zip(total, counted(x, fold, learning, mass, common)):
                all_.add(some)
        for kind, all_ in enumerate(total):
            yield from _pieces(kind, all_.counts.reshape(4 if kind >= CHOICE_KIND else 1, -1))

    return run


def _choosing(documents: int, common: Common, after: np.ndarray, tables):
    """Counts of bits by gate and states, each half of the training texts by the other one's tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Tally(4 * CHOICE_EVENTS)
        for x, fold, learning in _training_slices(batches, documents, common):
            word, nth, bit, slots = x.choices()
            use = learning[x.text[word]] & (x.apart[word] > 0)  # without the text the others are new words
            word, nth, bit, slots = word[use], nth[use], bit[use], slots[:, use]
            half = fold.astype(np.int32)[x.text][word]
            event = x.choice_gates(word, nth, after).astype(np.int32)
            for seen, n in zip(tables.value.ravel().take(slots + (1 - half) * tables.value.shape[1]), CHOICE_STATES):
                event = event * n + seen
            total.add(event + (2 * half + bit) * CHOICE_EVENTS)
        yield from _pieces(0, total.counts[None])

    return run


def _events_added(key, pieces):
    total = sum(restored(b, np.int32).astype(np.int64) for b in pieces.column("body").to_pylist())
    kind, at = key[0].as_py(), key[1].as_py()
    if kind >= CHOICE_KIND:  # the states of the halves' counts, and of both together
        total = total.reshape(2, 2, -1)
        body = np.array([states(*x, kind == CHOICE_KIND) for x in (*total, total.sum(axis=0))])
    else:
        body = total
    return pa.table({"kind": [kind], "at": [at], "body": pa.array([squeezed(body)], pa.binary())})


def _scores(n: int, v: int, ends_n: int, model, tables, mixer: Mixer):
    zero = np.log10(n + v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = predictions(tables.value)
        for batch in batches:
            for i in range(batch.num_rows):
                keys, held, sizes = (batch.column(x)[i].values for x in ("keys", "held", "sizes"))
                c, new = restored(batch.column("c")[i].as_py(), np.int64), zstandard.decompress(batch.column("new")[i].as_py())
                words, logp = pa.array(new.decode().split("\n") if new else [], pa.string()), np.zeros(len(c), np.float32)
                if len(words):
                    logp[c == 0] = np.concatenate([word_scores(words.slice(k, 10_000), *spelling, mixer) for k in range(0, len(words), 10_000)])
                for first, last, x in _slices(batch, i, ends_n, model.value.common):
                    sums = lambda values: np.bincount(x.text, values, x.texts)  # noqa: B023, E731
                    base = sums(np.log10(x.c + 1) - zero) + np.log10(ends_n + 1) - zero
                    score = model.value.scores(x, logp)
                    known = sums(x.c > 0).astype(np.int64) + int(ends_n > 0)
                    some = slice(first, last)
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys[some], held[some], pa.array(np.diff(x.ends) + 1), pa.array(known), pa.array(np.full(last - first, n), pa.int64()), pa.array(base), pa.array(score),
                            pa.array(-score * np.log2(10) / sizes.to_numpy()[some]), pa.array(sums(~x.spelled).astype(np.int64)),
                        ],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte", "n_followed"],
                    )
            give_back()

    return run


def score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, n_followed; one row per row of docs.

    Rows whose crc32 of the id as text, modulo 7, is 2 are held out; rows without an id count as training rows. A-Z are lowered; tokens are
    runs without ASCII white space, and one end. score is the log10 probability that the model gives to the text (-score * 3.3219 are the total bits);
    bits_per_byte divides those bits by the bytes that are told: those of the words, and one that ends each and the text. n_followed counts words
    of segments that other training texts, or the same text before, have had after the same segment; a text's own later words never count for that.
    Null and empty texts have the end alone. Very long texts are read whole, one of them alone at worst. Columns other than the two that are
    named are left out, whatever their names. Repeated rows count each; an empty table gives no rows, and one without training rows is
    scored by the untrained model. Partitions make no difference but that of rounding. Words and segments are told apart by 64-bit hashes, which
    for a thousand million words meet by chance with a probability of 3 %.
    """
    spark = docs.sparkSession
    work = Work(spark)
    held = F.coalesce(F.pmod(F.crc32(docs[key].cast("string")), F.lit(7)) == 2, F.lit(False))
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"), held.alias("held_out"))
    found = rows.mapInArrow(_squeezed, BLOCK)
    blocks = work.table(found.withColumn("block", F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("number")).drop("number"), "blocks")
    learned = F.aggregate(F.zip_with("held", "counts", lambda held, n: F.when(held, 0).otherwise(n)), F.lit(0).cast("long"), lambda a, b: a + b)
    own = F.aggregate("held", F.lit(0).cast("long"), lambda a, held: a + (~held).cast("long"))
    every = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    ends, all_words, every, entries = (x or 0 for x in blocks.agg(F.sum(own), F.sum(learned), F.sum(every), F.sum("n_entries")).first())
    least = 1 << max(1, int(np.ceil(np.log2(max(all_words, 1) / COMMON))))
    # ranges don't depend on partitions, and no bucket has a part of one: there are no more than two entries a word
    bits, ranges = (max(0, int(np.ceil(np.log2(max(x, 1) / y)))) for x, y in ((entries, ENTRIES), (every, RANGE)))
    parcels = blocks.select("block", "entries", "taught", "n_words").mapInArrow(_parcels(bits), "bucket long, block long, entries binary, taught binary, words long")
    totals = parcels.groupBy("bucket").applyInArrow(_totals(ranges, least), "block long, bucket long, rest binary, first binary, numbers binary")
    totals = totals.groupBy("block").agg(F.collect_list(F.struct("bucket", "rest", "first", "numbers")).alias("totals"))  # at most buckets rows of a block, and no more than it has entries
    both = work.table(blocks.join(totals, "block", "left").mapInArrow(_joined(bits, ranges, least), JOINED), "texts")
    work.drop(blocks)

    training = both.select(F.explode(F.arrays_zip("fresh", "fresh_c")).alias("w")).select(F.col("w.fresh").alias("word"), F.col("w.fresh_c").alias("c"))
    classes = training.groupBy(F.least(F.lit(END - 1), F.floor(F.log2("c") + F.lit(1e-9)) + 1).cast("int").alias("class")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n, v = sum(r.n for r in classes) + ends, sum(r.v for r in classes) + int(ends > 0)
    mass = np.zeros(CLASSES)
    for r in classes:
        mass[r["class"]] = r.n
    pieces = training.mapInArrow(_counting, "at long, body binary").groupBy("at").applyInArrow(_adding, "at long, body binary").collect()
    tables = np.zeros(2 * OFFSETS[-1], np.int32)
    for r in pieces:
        tables[r[0] : r[0] + PIECE][: len(r[1]) // 4] = np.frombuffer(r[1], np.int32)
    shared = spark.sparkContext.broadcast(tables.reshape(2, -1))  # OFFSETS[-1] pairs, whatever the corpus
    mixer, _ = fitted(training, shared)
    top = training.where(F.col("c") >= least).collect()  # COMMON rows at most
    common = Common(hashed(pa.array([r.word for r in top], pa.string())), np.array([r.c for r in top], np.int64), least)
    counts = [np.zeros(n, np.int64) for n in common.sizes]
    states_ = np.zeros((3, CHOICE_OFFSETS[-1]), np.uint8)
    events = "kind long, at long, body binary"
    for r in both.mapInArrow(_events(ends, mass, common), events).groupBy("kind", "at").applyInArrow(_events_added, events).collect():  # as many counts as common.sizes has, and states
        if r.kind >= CHOICE_KIND:
            some, at = restored(r.body, np.uint8).reshape(3, -1), int(CHOICE_OFFSETS[r.kind - CHOICE_KIND]) + r["at"]
            states_[:, at : at + some.shape[1]] = some
        else:
            some = restored(r.body, np.int64)
            counts[r.kind][r["at"] : r["at"] + len(some)] = some
    model = Model(counts, common)
    halves, chosen = spark.sparkContext.broadcast(states_[:2]), np.zeros(4 * CHOICE_EVENTS, np.int64)
    for r in both.mapInArrow(_choosing(ends, common, model.after, halves), events).groupBy("kind", "at").applyInArrow(_events_added, events).collect():  # CHOICE_EVENTS at most
        some = restored(r.body, np.int64)
        chosen[r["at"] : r["at"] + len(some)] = some
    model.choose(chosen.reshape(2, 2, -1), states_[2])
    model = spark.sparkContext.broadcast(model)
    return both.mapInArrow(_scores(n, v, ends, model, shared, mixer), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double, n_followed long")
