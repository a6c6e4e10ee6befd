"""Language model, order, toxicity, sharding, search, licences, pages and the pipeline."""

import collections
import heapq
import html as entities
import math
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from atlas.llm import html, licenses, mixing, order, queries, sharding, topk, toxicity
from atlas.llm.common import Work, by_hash
from tests.conftest import rows as rows_of
from tests.llm.conftest import crc

# --- language model


def base_scores(rows):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    learned, ends = collections.Counter(), 0
    for (i, _), w in zip(rows, tokens):
        if i is None or crc(i) % 7 != 2:
            learned.update(w)
            ends += 1
    n, v = sum(learned.values()) + ends, len(learned) + (ends > 0)
    return [(len(w) + 1, sum(learned[x] > 0 for x in w) + (ends > 0), n, sum(math.log10((c + 1) / (n + v + 1)) for c in [*(learned[x] for x in w), ends])) for w in tokens]


def test_base_scores(odd, odd_rows):
    pairs = [(r[0], r[1]) for r in odd_rows]
    got = sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in mixing.score(odd).collect())
    assert got == sorted((a, b, c, round(d, 4)) for a, b, c, d in base_scores(pairs))


def test_scores_on_held_out_texts(spark, sf_dir):
    rows = queries.op1_mixing(spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (crc(r.doc_id) % 7 == 2) and -1e9 < r.score < 0 for r in rows)
    learned = [r for r in rows if not r.held_out]
    assert sum(r.score for r in learned) > sum(r.base_score for r in learned)
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -5


def test_blocks_of_later_slices():
    """Rows beyond the first slice of a batch keep their words."""
    texts = [f"Word{i} AND{i % 7}" for i in range(10_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(10_000)), "text": texts, "held_out": [False] * 10_000})
    found = []
    for b in mixing._blocks(iter([batch])):
        vocabulary, at = b.column("vocab")[0].values.to_pylist(), np.frombuffer(b.column("at")[0].as_py(), np.int32)
        assert b.column("counts")[0].values.to_pylist() == [2] * len(b.column("keys")[0].values)
        found += [vocabulary[i] for i in at]
    assert found == " ".join(texts).lower().split()


def test_every_training_word_trains(spark):
    tables = spark.sparkContext.broadcast(np.zeros((2, mixing.OFFSETS[-1]), np.float32))
    words = spark.range(500).select(F.concat(F.lit("w"), "id").alias("word"), F.lit(2).cast("long").alias("c")).repartition(3)
    assert mixing.fitted(words, tables)[1] == 500
    mixer, n = mixing.fitted(words.limit(0), tables)
    assert n == 0 and (mixer.weights == mixing.Mixer().weights).all()


def test_bits_per_byte(spark):
    texts = ["ab  Cde", " é ", "", None, "x" * 300]
    got = {r.doc_id: r for r in mixing.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, size in enumerate([3 + 4 + 1, 3 + 1, 1, 1, 302]):
        assert got[i].bits_per_byte == pytest.approx(-got[i].score * math.log2(10) / size)


def test_word_probabilities_are_a_distribution():
    """All words over two letters of up to one byte, and everything longer, can't exceed one."""
    tables = np.random.default_rng(1).poisson(1.0, (2, mixing.OFFSETS[-1])).astype(np.float32)
    one = pa.array(["", *[bytes([b]).decode("latin1") for b in range(128) if b != 32]])
    p = 10.0 ** mixing.word_scores(one, *mixing.predictions(tables), mixing.Mixer())
    assert 0 < p.sum() < 1


def test_earlier_and_segments():
    before, every = mixing.earlier(np.array([4, 7, 4, 4, 7, 1]))
    assert before.tolist() == [0, 0, 1, 2, 1, 0] and every.tolist() == [3, 2, 3, 3, 2, 1]
    words_ = pa.array([f"w{i}" for i in range(50)])
    h = mixing.hashed(words_)
    assert len(set(h.tolist())) == 50 and mixing.hashed(words_.take(pa.array([7]))).tolist() == [h[7]]
    text = np.random.default_rng(1).integers(0, 50, 3000)
    twice, ends = np.concatenate([text, [3], text[5:], []]).astype(int), np.array([0, 3000, 3001, 3001, 5996])
    starts, before, own = mixing.segments(h[twice], ends)
    assert {0, 3000, 3001} <= set(starts.tolist()) and 50 < len(starts) < 400
    assert (before[np.isin(starts, [0, 3000, 3001])] == 0).all()
    assert len(set(own[starts < 3000].tolist()) - set(own[starts > 3000].tolist())) <= 2  # the same places are found again


def test_tallies_take_no_second_table():
    """Counts are added up in place, whatever is added, however often."""
    places = [np.array([5, 5, 0], np.int32), np.array([], np.int32), np.random.default_rng(1).integers(0, 1 << 22, 5_000).astype(np.int32)]
    tracemalloc.start()
    tally = mixing.Tally(1 << 22)
    for some in places:
        tally.add(some)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (tally.counts == np.bincount(np.concatenate(places), minlength=1 << 22)).all()
    assert peak < 1.5 * tally.counts.nbytes


def test_bits_equal_a_single_stream():
    """Many texts side by side are told as each alone, bit by bit."""
    rng = np.random.default_rng(2)
    texts, n, gates = 4, 400, 3
    counts = rng.integers(0, 50, (2, 2, 12)).astype(float)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(3), np.arange(4), indexing="ij"))
    bits = mixing.Bits([a, a * 4 + b], a, counts)
    g, c, value, text = rng.integers(0, gates, n), rng.integers(0, 4, n), rng.integers(0, 2, n), np.sort(rng.integers(0, texts, n))
    place = np.concatenate([np.arange(k) for k in np.bincount(text, minlength=texts)])
    got = bits.follow([g, g * 4 + c], g, value, text, place, texts)
    for t in range(texts):
        own, shift, misses, seen = np.zeros((2, gates)), np.zeros(3), [], []
        for k, i in enumerate(np.flatnonzero(text == t)):
            if k >= mixing.FIRST and (k // mixing.FIRST) & (k // mixing.FIRST - 1) == 0 and k % mixing.FIRST == 0:  # places 16, 32, 64 and so on
                shift = np.clip(shift + mixing.RATE * np.sum(misses, axis=0) / len(misses), -1, 1)
                for gate, v in seen:
                    own[v, gate] += 1
                misses, seen = [], []
            inputs = np.array([bits.tables[0][g[i]], bits.tables[1][g[i] * 4 + c[i]], math.log((own[1, g[i]] + 0.4) / (own[0, g[i]] + 0.4))])
            x = float(((bits.weights[g[i]] + shift) * inputs).sum())
            p = 1 / (1 + math.exp(-x))
            fine = (p + bits.map[round((min(max(x, -8), 8) + 8) * (mixing.MAP_STEPS - 1) / 16)]) / 2
            assert got[i] == pytest.approx(math.log10(fine if value[i] else 1 - fine), abs=1e-4)
            misses.append((value[i] - p) * inputs)
            seen.append((g[i], value[i]))


def test_untold_bits_are_mixtures():
    """With odds in place of bits the result is that of the mixture of both ways; without own counts it needs p alone."""
    rng = np.random.default_rng(3)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(3), np.arange(4), indexing="ij"))
    bits = mixing.Bits([a, a * 4 + b], a, rng.integers(0, 50, (2, 2, 12)).astype(float))
    n = mixing.FIRST  # before any update
    g, c, text, place = rng.integers(0, 3, n), rng.integers(0, 4, n), np.zeros(n, int), np.arange(n)
    ones = 10.0 ** bits.follow([g, g * 4 + c], g, np.ones(n, int), text, place, 1)
    odds = np.where(np.arange(n) % 3 == 0, 0.0, rng.exponential(3, n))
    got = bits.follow([g, g * 4 + c], g, None, text, place, 1, odds)
    assert got == pytest.approx(np.log10(ones * odds + 1 - ones), abs=1e-6)
    # odds that are all but infinite tell the bit, for later updates, too
    g, c, text, place, value = (np.tile(x, 8) for x in (g, c, text, place, np.arange(n) % 2))
    place = np.arange(8 * n)
    told = bits.follow([g, g * 4 + c], g, value, text, place, 1)
    untold = bits.follow([g, g * 4 + c], g, None, text, place, 1, np.where(value == 1, 1e12, 0.0))
    assert untold - np.where(value == 1, 12, 0) == pytest.approx(told, abs=1e-3)


def test_shares_are_the_likeliest():
    counts = np.random.default_rng(5).integers(0, 90, (2, 3, mixing.RATIOS))
    counts[0, 0] = 0
    zero, ones = mixing.shares(counts)
    assert zero + ones == pytest.approx(counts.sum(axis=-1))
    odds = np.array([0.0] + [2.0 ** (k - mixing.RATIOS // 2) for k in range(1, mixing.RATIOS)])
    assert mixing.ratios(odds).tolist() == list(range(mixing.RATIOS))
    grid = np.linspace(0.001, 0.999, 999)
    for i, j in [(0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]:
        best = grid[np.argmax([(counts[i, j] * np.log(p * odds + 1 - p)).sum() for p in grid])]
        assert ones[i, j] / (zero + ones)[i, j] == pytest.approx(best, abs=0.005)


def test_common_words_after_common_words(spark):
    """Where a common word always follows another one, texts that keep the order are worth more than the same words in another order."""
    r = np.random.default_rng(6)
    follows = {f"w{k}": f"w{(k * 7 + 3) % 40}" for k in range(40)}

    def text(keeps: bool) -> str:
        out = [f"w{r.integers(40)}"]
        while len(out) < 400:
            out.append(follows[out[-1]] if keeps and r.random() < 0.7 else f"w{r.integers(40)}")
        return " ".join(out)

    texts = {i: text(True) for i in range(120)}
    held = [i for i in texts if crc(i) % 7 == 2]
    shuffled = {i: " ".join(r.permutation(texts[i].split())) if i in held else texts[i] for i in texts}
    one, other = ({x.doc_id: x for x in mixing.score(spark.createDataFrame(list(t.items()), "doc_id long, text string")).collect()} for t in (texts, shuffled))
    assert len(held) > 8
    assert all(one[i].score > one[i].base_score + 50 and one[i].score > other[i].score + 50 for i in held if one[i].n_followed == 0 == other[i].n_followed)


def test_choice_of_a_common_word_is_a_distribution():
    counts = np.array([900, 700, 640, 2000, 1100])
    common = mixing.Common(np.array([5, 2, 9, 1, 7], np.uint64), counts, 512)
    assert common.hashes.tolist() == [1, 2, 5, 7, 9] and common.counts.tolist() == [2000, 700, 900, 1100, 640]
    events = [np.zeros(n, np.int64) for n in common.sizes]
    events[3][:] = np.random.default_rng(7).integers(0, 30, 25)
    model = mixing.Model(events, common)
    classes = common.classes[:-1]
    mass = np.bincount(classes, common.counts, mixing.CLASSES)
    for first in range(5):
        p = (model.pairs[first] + mixing.PAIR_PRIOR * common.counts / mass[classes]) / (model.after[first, classes] + mixing.PAIR_PRIOR)
        assert np.bincount(classes, p)[np.unique(classes)] == pytest.approx(1)


def test_codes_of_words_are_a_distribution():
    """The codes of a class's words differ and none begins another one, whether words are common or begin with some bits of their hashes."""
    groups = np.array([3, 5, 3, 3, 3, 3, 7, 5])
    numbers = mixing.numbered(groups)
    assert sorted(numbers[groups == 3].tolist()) == [8, 9, 10, 11, 12] and numbers[groups == 5].tolist() == [2, 3] and numbers[6] == 1
    entries = np.sort(np.random.default_rng(8).integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
    key = pa.array([0])
    ranges, taught = 4, np.repeat([1, 2, 900], 1000)
    group = pa.table({"block": [0], "entries": [entries.tobytes()], "taught": [mixing.squeezed(taught)], "words": [2500]})
    got = mixing.restored(mixing._totals(ranges, 512)((key[0],), group).column("numbers")[0].as_py(), np.int64)
    assert (got[:2000] > 0).all() and (got[2000:] == 0).all()  # common words and segments have none
    for some in (slice(0, 1000), slice(1000, 2000)):
        codes = {f"{h:0{ranges}b}{n:b}" for h, n in zip(mixing.leading(entries[some], ranges), got[some])}
        whole = [c[:ranges] + c[ranges + 1 :] for c in codes]
        assert len(set(whole)) == 1000 and not any(a != b and b.startswith(a) for a, b in zip(sorted(whole), sorted(whole)[1:]))


def test_choice_of_a_word_is_told_bit_by_bit(spark):
    """The bits of a word's code are mixed from contexts of the one and the two words before, whichever word it is: here
    a rare word depends on the two words before together, so that counts of single words can't tell it."""
    r = np.random.default_rng(9)

    def text() -> str:
        out = []
        while len(out) < 300:
            a, b = r.integers(60, size=2)
            out += [f"v{a}", f"v{b}", f"w{a}x{b}"]
        return " ".join(out)

    texts = {i: text() for i in range(400)}
    held = [i for i in texts if crc(i) % 7 == 2]
    split = {i: t.split() for i, t in texts.items()}
    # the words that depend on others change places among themselves, so that the order of classes stays
    moved = {i: [*w] for i, w in split.items()}
    for i in held:
        moved[i][2::3] = r.permutation(split[i][2::3]).tolist()
    one, other = ({x.doc_id: x for x in mixing.score(spark.createDataFrame([(i, " ".join(w)) for i, w in t.items()], "doc_id long, text string")).collect()} for t in (split, moved))
    plain = [i for i in held if one[i].n_followed == 0 == other[i].n_followed]
    gains = [(one[i].score - other[i].score) / one[i].n_tokens for i in plain]
    assert len(plain) > 8 and np.mean(gains) > 0.4


def test_scores_for_any_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 300")
    one, many = ({r.doc_id: r for r in mixing.score(docs.repartition(k, "doc_id")).collect()} for k in (1, 8))
    assert len(one) == 300
    for i, r in one.items():
        assert many[i].score == pytest.approx(r.score, rel=1e-5) and many[i].n_followed == r.n_followed


def test_copies_are_followed(spark):
    """A text that stands elsewhere in the training texts costs far fewer bits; one that stands once isn't helped by itself."""
    r = np.random.default_rng(4)
    vocabulary = ["".join(r.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    texts = [" ".join(r.choice(vocabulary, 300)) for _ in range(40)]
    rows = [(i, texts[i % 36] if i < 40 else texts[i]) for i in range(40)]
    got = {r.doc_id: r for r in mixing.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    copied = {i for i in range(40) if sum(j != i and rows[j][1] == rows[i][1] and crc(j) % 7 != 2 for j in range(40))}
    assert copied
    for i, x in got.items():
        assert (x.n_followed > 150) == (i in copied)
    alone = np.mean([x.bits_per_byte for i, x in got.items() if i not in copied])
    assert np.mean([got[i].bits_per_byte for i in copied]) < alone / 2


def test_held_out_scores_beat_the_base(spark, sf_dir):
    held = [r for r in queries.op1_mixing(spark, sf_dir).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_no_rows(empty):
    assert mixing.score(empty).count() == 0


# --- training order


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_slots_are_a_permutation(n):
    got = order.slots(np.arange(n), n, 42)
    assert sorted(got) == list(range(n))
    assert (order.indexes(got, n, 42) == np.arange(n)).all()
    assert n < 10 or (order.slots(np.arange(n), n, 43) != got).any()


def test_shards_hold_every_sequence(spark, tmp_path):
    ids = {i: list(range(i * 100, i * 100 + n)) for i, n in enumerate([0, 1, 7, 8, 9, 40, 16])}
    rows = [(i, x) for i, x in ids.items()] + [(99, None), (5, ids[5])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(3)
    folder = f"file://{tmp_path}/shards"
    found = order.materialise(df, folder, key=7, length=8, per_shard=4).collect()
    assert sorted(r.slot for r in found) == list(range(len(found)))
    read = list(order.read(folder, 0, 10**6, 8, 4))
    assert len(read) == len(found)
    seen = collections.Counter()
    for r in found:
        assert r.shard == r.slot // 4 and r.offset == r.slot % 4 * 18 and r.n_tokens == len(read[r.slot]) == sum(p.n for p in r.parts)
        for p in r.parts:
            mine = [*ids[p.doc_id], order.END_ID][p.begin : p.begin + p.n]
            assert read[r.slot][p.at : p.at + p.n].tolist() == mine
            seen.update((p.doc_id, p.begin + k) for k in range(p.n))
    assert seen == collections.Counter((i, k) for i, x in rows if x for k in range(len(x) + 1))
    assert [x.tolist() for x in order.read(folder, 5, 3, 8, 4)] == [x.tolist() for x in read[5:8]]


def test_order_of_odd_rows(spark, odd, empty, odd_rows):
    got = collections.Counter()
    for r in order.materialise_documents(odd).collect():
        for p in r.parts:
            got[p.doc_id] += p.n
    assert got[4] == got[5] == 0 and got[8] > 20 and got[7] > 60_000 and None in got
    assert order.materialise_documents(empty).count() == 0


def test_packing_goes_on_from_slice_to_slice():
    """Sequences of slices equal those of all documents at once, each full but the last one."""
    ids = [list(range(i * 50, i * 50 + n)) for i, n in enumerate([3, 0, 8, 1, 25, 7, 0, 16, 2])]
    for cuts in ([0, 9], [0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [0, 2, 4, 9], [0, 7, 9]):
        packer, bodies, parts = order.Packer(8, order.END_ID), [], []
        for a, b in zip(cuts, cuts[1:]):
            some = ids[a:b]
            got = packer.add(pa.array(range(a, b)), np.cumsum([0, *map(len, some)]), np.array([x for t in some for x in t], np.int32))
            bodies, parts = bodies + got[0], parts + got[1].to_pylist()
        got = packer.rest()
        bodies, parts = bodies + got[0], parts + got[1].to_pylist()
        stream = [x for t in ids if t for x in [*t, order.END_ID]]
        assert [np.frombuffer(b, "<u2").tolist() for b in bodies] == [stream[k : k + 8] for k in range(0, len(stream), 8)]
        for body, part in zip(bodies, parts):
            assert [x for p in part for x in [*ids[p["doc_id"]], order.END_ID][p["begin"] : p["begin"] + p["n"]]] == np.frombuffer(body, "<u2").tolist()
            assert [p["at"] for p in part] == np.cumsum([0, *[p["n"] for p in part]])[:-1].tolist()


def test_repeated_tasks_commit_once(tmp_path):
    import pyarrow.fs

    fs = pyarrow.fs.LocalFileSystem()
    for made in ("a", "b"):
        (tmp_path / made).write_bytes(b"same")
        order.commit(fs, f"{tmp_path}/{made}", f"{tmp_path}/shard")
    assert [f.name for f in tmp_path.iterdir()] == ["shard"]


def test_shards_are_not_mixed(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1, 2, 3])], "doc_id long, ids array<int>")
    order.materialise(rows, f"file://{tmp_path}/s", length=8, per_shard=4).collect()
    with pytest.raises(ValueError):
        order.materialise(rows, f"file://{tmp_path}/s", length=8, per_shard=4)


# --- toxicity


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(5)
    bad = ["vileword", "nastything", "hatefulone"]
    rows, labels = [], []
    for i in range(3000):
        w = [f"t{rng.zipf(1.3) % 5000}" for _ in range(60)]
        toxic = int(i % 9 == 0)
        if toxic:
            for k in rng.integers(0, 3, 2):
                w[rng.integers(0, 60)] = bad[k]
        rows.append((i, " ".join(w)))
        if i % 2 == 0 or toxic:
            labels.append((i, 1, toxic))
    docs, said = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.report(docs, said).collect()}
    assert all(r.held_out == (crc(i) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in found.items())
    held = [i for i in found if found[i].held_out]
    right = [found[i].predicted == (i % 9 == 0) for i in held]
    assert sum(right) / len(right) > 0.97


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1), (2, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    none = labels.where("false")
    for said in (labels, none):
        got = toxicity.report(odd, said).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert toxicity.keep_clean(odd, said).columns == odd.columns
    assert toxicity.report(empty, labels).count() == 0


# --- sharding


def heap_shards(histogram, shards):
    heap, out = [(0, k) for k in range(shards)], collections.Counter()
    for size, m in sorted(histogram, reverse=True):
        for _ in range(m):
            at, k = heap[0]
            heapq.heapreplace(heap, (at + size, k))
            out[size, k] += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_schedule_equals_the_heap(seed):
    rng = np.random.default_rng(seed)
    histogram = [(int(s), int(rng.integers(1, 200))) for s in set(rng.integers(1, 500, 40).tolist())]
    shards = int(rng.integers(1, 9))
    got = collections.Counter()
    for size, lo, hi, k in sharding.schedule(histogram, shards):
        got[size, k] += hi - lo
    want = heap_shards(histogram, shards)
    loads = [[sum(s * c for (s, x), c in counts.items() if x == k) for k in range(shards)] for counts in (got, want)]
    assert got == want and loads[0] == loads[1]


def test_sharding_of_odd_rows(odd, odd_rows, empty):
    got = sharding.shard(odd, 4).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in odd_rows)
    where = collections.defaultdict(set)
    for r in got:
        where[r.text_crc32, r.size].add(r.shard)
    assert all(len(x) == 1 for x in where.values())
    for k in range(4):
        mine = sorted(r.slot for r in got if r.shard == k)
        assert mine == list(range(len(mine)))
    assert sharding.shard(empty, 4).count() == 0


def test_sharding_is_level(spark, sf_dir):
    loads = [r[1] for r in queries.op5_sharding(spark, sf_dir).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(loads) == 8 and max(loads) - min(loads) < 0.001 * sum(loads)


# --- search


def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [0.5, 1.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.5]), (20, [0.0, -1.0]), (20, [0.0, -1.0]), (None, [1.0, 1.0]), (8, [-0.01, 2.0]), (9, [1.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in good if i % 20 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in good if i != q and len(x) == len(v))[:3]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    assert sorted(map(tuple, topk.topk(df, 3).collect())) == sorted(want)
    assert topk.topk(df.where("false")).count() == 0


def test_search_in_several_passes(spark, sf_dir, monkeypatch):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    once = sorted(map(tuple, topk.topk(e, 5).collect()))
    monkeypatch.setattr(topk, "QUERY_BYTES", 4096)
    assert sorted(map(tuple, topk.topk(e, 5).collect())) == once


# --- licences


def test_licences(spark, odd, empty):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nThe software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."
    texts = [mit, "Text. Released under the MIT License.", "mit license", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", None, ""]
    got = [r.asDict() for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [(r["licenses"], r["license"], r["kind"], r["n_sentences"]) for r in got] == [("MIT", "MIT", "text", 3), ("MIT", "MIT", "reference", 1), ("", None, None, 0), ("CC-BY-NC-4.0,MIT", "MIT", "reference", 2), ("", None, None, 0), ("", None, None, 0)]
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty).count() == 0
    plan = licenses.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


WRAPPED = {
    "MIT": 'MIT License\n\nCopyright (c) 2020 A. Name\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS BE LIABLE.',
    "BSD-3-Clause": "Copyright 2020. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n",
    "Apache-2.0": '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an "AS IS" BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n# See the License for the specific language.',
    "GPL-3.0-or-later": "    This program is free software: you can redistribute it and/or modify\r\n    it under the terms of the GNU General Public License as published by\r\n    the Free Software Foundation, either version 3 of the License, or\r\n    (at your option) any later version.\r\n\r\n    This program is distributed in the hope that it will be useful,\r\n    but WITHOUT ANY WARRANTY; without even the implied warranty of\r\n    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\r\n    GNU General Public License for more details.\r\n\r\n    You should have received a copy of the GNU General Public License\r\n    along with this program.  If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along\nwith this program; if not, write to the Free Software Foundation, Inc.",
    "GPL-3.0-only": "This work is licensed under the GNU General\nPublic License, version 3.",
    "CC-BY-NC-4.0": "Licensed under\nCC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International\nLicense.",
    "CC-BY-SA-4.0": "Licensed under CC\nBY-SA 4.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the\npublic domain.",
}
_LGPL = "This library is free software{0} you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation{1} either\nversion {2} of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\nLesser General Public License for more details.\n\nYou should have received a copy of the GNU Lesser General Public\nLicense along with this library; if not, write to the Free Software\nFoundation, Inc."
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND\nFITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE'
MORE = [
    ("MIT", WRAPPED["MIT"].replace("AUTHORS BE LIABLE.", "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.")),
    ("BSD-3-Clause", "\n".join(" * " + x for x in WRAPPED["BSD-3-Clause"].replace("copyright holder nor", "University nor").split("\n")) + '\n * THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\n * AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\n * IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\n * DISCLAIMED.'),
    ("Apache-2.0", "/*\n" + "\n".join(x.replace("#", " *", 1) for x in WRAPPED["Apache-2.0"].removesuffix(".").split("\n")) + " governing permissions and\n * limitations under the License.\n */"),
    ("GPL-2.0-only", "// This program is free software; you can redistribute it and/or modify\n// it under the terms of the GNU General Public License version 2 as\n// published by the Free Software Foundation.\n"),
    ("LGPL-2.1-or-later", _LGPL.format(";", ";", "2.1")), ("LGPL-3.0-or-later", _LGPL.format(":", ",", "3")),
    ("AGPL-3.0-or-later", WRAPPED["GPL-3.0-or-later"].replace("GNU General", "GNU Affero General")),
    ("ISC", WRAPPED["ISC"] + "\n\n" + _ISC), ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.\n\n" + _ISC),
    ("Unlicense", WRAPPED["Unlicense"] + "\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans."),
    ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin"),
    ("BSL-1.0", "//          Distributed under the Boost Software License, Version 1.0.\n//    (See accompanying file LICENSE_1_0.txt)"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0\nInternational License"),
    *[(name, f"#!/bin/sh\n# SPDX-License-Identifier: {name}\n# Copyright 2020\nset -e") for name in licenses.TAGGED],
]
SHORT = {"Apache-2.0": "Licensed under the Apache License,\nVersion 2.0.", "MIT": "Released under\nthe MIT License.", "CC-BY-4.0": "Licensed under\nCC BY 4.0."}


def test_licences_in_wrapped_notices(spark):
    bsd2 = WRAPPED["BSD-3-Clause"].split("3. Neither")[0]
    texts = [*WRAPPED.items(), *SHORT.items(), ("BSD-2-Clause", bsd2), (None, "Released under\n\nthe MIT License."), (None, "Released under. The MIT License"), (None, "He released under\nthe MIT License"), (None, ";\n" * 50_000 + "." * 100_000 + "\n" * 100_000), *MORE]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(len(texts))] == [name for name, _ in texts]
    kinds = {name: got[i].kind for i, (name, _) in enumerate(WRAPPED.items())}
    assert [n for n, k in kinds.items() if k != "reference"] == ["MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0-or-later", "GPL-2.0-or-later"]
    every = {i for r in got.values() for i in r.sentence_ids.split(",")}
    tags = {f"spdx-{name.lower()}" for name in licenses.TAGGED}
    bodies = {x for x in licenses.SENTENCES.values() if x.endswith("-title") or x.startswith(("epl2-", "cc0-", "mpl2-", "gpl3-only", "fsf-", "bsd-advert", "bsd-product", "apache2-terms"))}  # tests of bodies have these
    assert tags <= every and set(licenses.SENTENCES.values()) - bodies <= every <= set(licenses.SENTENCES.values()) | tags | {""}


def test_licence_sql_agrees_on_notices(spark):
    """The SQL, written by other means, on every notice, wrapped, indented and commented, and on them all in one text."""
    import duckdb

    texts = [*[t for _, t in [*WRAPPED.items(), *SHORT.items(), *MORE]], "\n\n".join([*WRAPPED.values(), *[t for _, t in MORE]]), "licensed under the apache license; version 2.0.", "a v. 2.0 v.\n3 all rights reserved", None, "", "All rights\n\nreserved. ALL RIGHTS RESERVED!?"]
    documents = pa.table({"doc_id": range(len(texts)), "text": texts})
    other = duckdb.sql(licenses.oracle()).df()  # reads documents
    mine = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    assert len(documents) == len(mine) and rows_of(mine) == rows_of(other)


# --- pages


def plain(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


def test_pages_against_their_articles(spark, sf_dir):
    want = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op9_html(spark, sf_dir).collect()}
    assert all(got[i].n_chars == len(got[i].text) for i in got)
    assert sum(got[i].text == t for i, t in want.items()) >= 0.99 * len(want)


@pytest.mark.parametrize("copies", [1, 2, 400])
def test_samples_of_repeated_rows(spark, copies):
    """The sample depends on which rows there are, not on how often each stands there."""
    rows = spark.range(300).select(F.concat(F.lit("page "), "id").alias("page"))
    want = sorted((h, p) for p, h in rows.select("page", F.pmod(F.xxhash64("page"), F.lit(1 << 40))).collect())[:240]
    got = by_hash(rows.join(spark.range(copies).select(F.col("id").alias("copy"))).select("page"), "page", 240).collect()
    assert sorted(r.page for r in got) == sorted(p for _, p in want)
    assert by_hash(rows.limit(5), "page", 240).count() == 5 and by_hash(rows.limit(0), "page", 240).count() == 0


def test_outer_names_of_deep_blocks():
    deep = lambda outer: html.features(html.leaves(f"<body><{outer}>" + "<div>" * 14 + "Some words." + "</div>" * 14))
    assert (deep("article") != deep("aside class='sidebar'")).any()


def test_raw_elements_end():
    """Self-closed svg and math have no content, and elements whose names only begin like raw ones keep their text."""
    text = lambda page: " ".join(x.text for x in html.leaves(page))
    assert text("<p>a <svg viewBox='0 > 1' /> b</p><p>c <math/> d</p>") == "a b c d"
    assert text("<object-list><p>a</p></object-list><select-box>b</select-box> c") == "a b c"
    assert text("<p>a</p><svg><path/><text>no</text></svg><script/>no</script><SVG\nid=x>no</SVG><title>no</title>b") == "a b"


def test_odd_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    long = "<article>" + "<p>Some words of a paragraph &amp; more.</p>" * 3000 + "</article>"
    odd = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (None, "u", "<p"), (-3, "u", "<<<>>> <p class='a"), (-4, "u", long), (-4, "u", long)], pages.schema)
    got = {r.page_id: r for r in html.extract(pages.unionByName(odd)).where("page_id < 0 or page_id is null").collect()}
    assert got[-1].text == got[-2].text == "" and got[-1].n_chars == 0
    assert got[-4].text.count("\n") == 2999 and "&" in got[-4].text
    assert html.extract(pages.where("false")).count() == 0


def test_leaves():
    page = "<ul><li>a<li>b &lt;</ul><script>x='</p>'</script><p>c<br>d <b>e</b>f<!-- no --><div>g</div>"
    assert [x.text for x in html.leaves(page)] == ["a", "b <", "c d ef", "g"]


def test_long_pages_are_read_whole():
    """2,000 different blocks: labels and training take all of them, as one reading of the whole page gives them."""
    rng = np.random.default_rng(7)
    body = "".join(f"<div class='{'menu' if rng.random() < 0.5 else 'x' + str(i % 17)}'><p>block {i} {rng.integers(0, 99)}.</p></div>" for i in range(2000))
    page = html.features(html.leaves(f"<body><article>{body}</article></body>"))
    assert len(page) == 2000
    model = html.Labeller(5)
    x, mask = html.packed([page])
    whole = model.probabilities(x, mask)[:, 0] >= 0.5
    short = html.features(html.leaves("<p>a</p><p>b</p>"))
    got = html.label(model, [short, page, short])
    assert (got[1] == whole).all() and len(got[0]) == 2 and (got[0] == got[2]).all()
    sizes = [3, 20_000, 5, 5, 8000, 8200, 1]
    assert sorted(i for g in html.grouped(sizes, 2) for i in g) == list(range(7)) and all(len(g) == 1 or len(g) * max(sizes[i] for i in g) <= html.SIDE for g in html.grouped(sizes, 2))


def test_formulas_keep_their_text():
    text = lambda page: " ".join(x.text for x in html.leaves(page))
    assert text("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p>") == "Let x=1 be"
    assert text("<p>a <object data='x'>b</object> <canvas>c</canvas></p>") == "a b c"


def test_pages_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>a b.</p></article>", "text", 5, "h")], "page_id long, url string, html string, text string, n_chars long, page string")
    assert [tuple(r)[:2] for r in html.extract(rows).collect()] == [(1, "u")]


def test_gradients():
    """The LSTM's gradients against differences."""
    rng, model = np.random.default_rng(0), html.Labeller(1)
    model.p = {k: a.astype(np.float64) for k, a in model.p.items()}
    x, mask = rng.normal(size=(4, 3, html.INPUTS)), np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], bool)
    y = rng.integers(0, 2, mask.shape)

    def loss():
        p = model.probabilities(x, mask)
        return -(np.where(y == 1, np.log(p), np.log(1 - p)) * mask).sum() / mask.sum()

    g = model.gradients(x, mask, y)
    for k in model.p:
        flat = model.p[k].ravel()
        at = int(np.abs(g[k]).argmax())
        old = flat[at]
        flat[at] = old + 1e-3
        up = loss()
        flat[at] = old - 1e-3
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-3 - g[k].ravel()[at]) < 2e-3


# --- pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline
    from atlas.llm import bpe, decontam, jaccard

    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), Work(spark)
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    now = {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        docs = work.table(stage(spark, docs, sf_dir), f"stage-{k}")
        then = {r.doc_id for r in docs.collect()}
        if k == 0:
            want = {r.doc_id for r in toxicity.report(before, labels).where("predicted = 0").collect()}
        elif k == 1:
            want = {r.class_id for r in jaccard.join(before).collect()}
        elif k == 2:
            want = {r.doc_id for r in decontam.report(before, bench).where("not contaminated").collect()}
        else:
            want = now
        assert then == want and docs.count() == len(then), name
        assert k == 3 or docs.columns == before.columns
        now = then
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, pipeline.run(spark, sf_dir).collect()))
    assert docs.columns == bpe.digests(before).columns


def test_pipeline_of_odd_rows(spark, odd, sf_dir, tmp_path):
    import corpus_pipeline as pipeline

    odd.write.parquet(f"file://{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0 if t == "labels" else 40).write.parquet(f"file://{tmp_path}/{t}.parquet")
    found = [r.doc_id for r in pipeline.run(spark, f"file://{tmp_path}").collect()]
    assert {1, 7, 8, 9} <= set(found) and not {2, 3, 10} & set(found)
    spark.read.parquet(f"file://{tmp_path}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"file://{tmp_path}/{t}.parquet").write.parquet(f"file://{tmp_path}/none/{t}.parquet")
    assert pipeline.run(spark, f"file://{tmp_path}/none").count() == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Some

    from atlas.llm import common

    for master in ("local-cluster[3,2,3000]", "spark://host:7077", "yarn"):
        session = Some(conf=Some(get=lambda *_: None), sparkContext=Some(master=master, getCheckpointDir=lambda: None))
        with pytest.raises(ValueError):
            common.shared_dir(session)


def test_op2_frames_name_no_dictionary():
    """Each frame travels twice, and there is one dictionary."""
    import types

    import zstandard

    rng = np.random.default_rng(1)
    shared = types.SimpleNamespace(value=order.dictionary([rng.integers(0, 300, 512).astype("<u2") for _ in range(400)], 512))
    ids = rng.integers(0, 300, 2000)
    frames = [b for batch in order._sequences(iter([(pa.array([1]), np.array([0, 2000]), ids)]), 512, order.END_ID, shared) for b in batch.column("body").to_pylist()]
    assert shared.value and [zstandard.get_frame_parameters(f).dict_id for f in frames] == [0] * 4
    restore = zstandard.ZstdDecompressor(**order._zstd(shared.value)).decompress
    assert b"".join(map(restore, frames)) == np.append(ids, order.END_ID).astype("<u2").tobytes()


def test_spelling_leaves_a_word_out_once_a_slot(monkeypatch):
    """What a word's bits are predicted by without the word is found once for each slot of a task, not for each bit of each word and context."""
    import types

    import numpy as np
    import pyarrow as pa

    from atlas.llm import mixing

    words = pa.array([f"w{i * i}" for i in range(2500)])
    seen = np.zeros((2, mixing.OFFSETS[-1]), np.int32)
    for batch in mixing._counting(iter([pa.RecordBatch.from_arrays([words], names=["word"])])):
        for at, body in zip(*(batch.column(x).to_pylist() for x in ("at", "body"))):
            piece = np.frombuffer(body, np.int32)
            seen.reshape(-1)[at : at + len(piece)] = piece
    direct, calls = mixing.predictions, []
    monkeypatch.setattr(mixing, "predictions", lambda x: calls.append(x.shape) or direct(x))
    run = mixing._training(types.SimpleNamespace(value=seen))
    for g in (0, 1):
        run([pa.scalar(g)], pa.table({"word": words, "h": pa.array(range(len(words)))}))
    assert calls == [(2, mixing.OFFSETS[-1])] * 2
    spelled = mixing.Spelled(words)
    stretched, often = mixing.without(seen)
    for j in range(8):
        value, slots = spelled.bit(j)
        left = seen[:, slots].astype(float)
        left[0][:, value == 0] -= 1
        left[1][:, value == 1] -= 1
        for got, wanted in zip((stretched, often), direct(np.maximum(left, 0))):
            assert (got[value, slots] == wanted).all()
