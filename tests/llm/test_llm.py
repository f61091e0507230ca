"""The operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from helixloom.llm import exact_dedup, html_text, labelled, mixing, ogg_media, packing, pitman_yor, quality_gam, sharding, simhash_dedup, toxicity_fm
from helixloom.llm.queries import ORACLES, QUERIES, tokenizer_path
from pyspark.sql import functions as F
from verify_queries import canonical, connect

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Nulls, empty and blank texts, ties, repeats and a very long text.
ODD = [(1, None, "en", None, 0), (2, "", "en", "a", 0), (3, " \n\t", None, "a", 3), (4, "Same text here, twice over.", "en", "a", 27), (5, "Same text here, twice over.", "en", "b", 27),
       (5, "Same text here, twice over.", "en", "b", 27), (None, "No id. É ü", "de", "b", 10), (7, "word. " * 30000, "en", "c", 180000), (8, "<|endoftext|> it's", "en", "c", 18)]


@pytest.fixture(scope="module")
def odd(spark):
    """With extra columns whose names the operators use themselves."""
    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.selectExpr("*", "1 as score", "'x' as digest", "2 as slot", "3 as row", "'y' as fp", "4 as block")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), connect(SF).execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def check_pieces(rows, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, found in texts.items():
        want = Counter()
        for text in found:
            ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
            want[ids.tobytes()] += 1
        got = Counter()
        for r in by_doc[doc_id]:
            ids = next((i for i in (np.frombuffer(w, "<u4") for w in want) if len(i) == r.doc_tokens and zlib.crc32(i[r.start : r.start + r.length].tobytes()) == r.ids_crc32), None)
            assert ids is not None
            got[r.doc_tokens] += r.length
        assert sum(got.values()) == sum(len(w) // 4 * n for w, n in want.items())
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SIZE


def test_packing(docs, odd, none):
    for frame in (docs, odd):
        texts = defaultdict(list)
        for r in frame.select("doc_id", "text").collect():
            texts[r.doc_id].append(r.text)
        check_pieces(packing.pack(frame, tokenizer_path()).collect(), texts)
    assert packing.pack(none, tokenizer_path()).count() == 0
    p = packing.padding(packing.pack(docs.coalesce(1), tokenizer_path())).first()
    assert p.padding < 0.03 * p.tokens


def test_window_cuts_are_optimal():
    rng = random.Random(3)
    for _ in range(30):
        place = np.array([0, *sorted(rng.sample(range(1, 60), 14)), 60])
        cost = np.array([0, *[rng.choice([0, 2, 9]) for _ in place[1:-1]], 0])
        size = 20
        f = [0.0] + [math.inf] * (len(place) - 1)
        for j in range(1, len(place)):
            f[j] = min((f[i] + size - (place[j] - place[i]) + cost[j] for i in range(j) if place[j] - place[i] <= size), default=math.inf)
        if math.isfinite(f[-1]) and max(np.diff(place)) <= size and all(map(math.isfinite, f)):
            assert packing.best_cuts(place, cost, size)[1][-1] == f[-1]


def test_quality(spark, docs, labels, odd, none):
    wide = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = labelled.fold(3, 1)
    got = quality_gam.score(wide, quality_gam.train(wide, marks, held), [F.col("doc_id"), held.alias("h")]).join(marks, "doc_id").where("h").toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.95
    model = quality_gam.train(docs, labels.limit(0))
    assert set(quality_gam.score(odd, model, [F.col("doc_id")]).toPandas().score) == {0.5}
    assert quality_gam.keep_good(odd, model).columns == odd.columns and quality_gam.keep_good(none, model).count() == 0


def test_toxicity(spark, odd, none):
    wide = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = labelled.fold(5, 0)
    model = toxicity_fm.train(wide, marks, held)
    got = toxicity_fm.score(wide.join(F.broadcast(marks), "doc_id"), model, [F.col("doc_id"), F.col("toxic"), held.alias("h")]).where("h").toPandas()
    assert ((got.score >= 0.5) == (got.toxic == 1)).mean() > 0.97
    assert toxicity_fm.score(odd, model, [F.col("doc_id")]).count() == len(ODD) and toxicity_fm.score(none, model, [F.col("doc_id")]).count() == 0
    assert set(toxicity_fm.score(odd, toxicity_fm.train(wide, marks.limit(0)), [F.col("doc_id")]).toPandas().score) == {0.5}


def test_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    sets = [np.flatnonzero(np.append(rng.random(2) < 0.5, [True])) for _ in range(3000)]
    y = np.array([float({0, 1} <= set(s.tolist())) for s in sets])
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    slots = np.concatenate(sets).astype(np.int32)
    m = toxicity_fm.fit(slots, starts, y, size=8)
    assert ((m.score(slots, starts) >= 0.5) == (y == 1)).all()


def test_machine_learns_a_pair_without_marginals():
    """Either of two terms is toxic, both or none aren't, among 30 others."""

    def made(n, seed):
        rng = np.random.default_rng(seed)
        sets = [np.concatenate((np.flatnonzero(rng.random(2) < 0.5), 2 + np.sort(rng.choice(200, 30, replace=False)))) for _ in range(n)]
        y = np.array([float((0 in s[:2]) != (1 in s[:2])) for s in sets])
        return np.concatenate(sets).astype(np.int32), np.concatenate(([0], np.cumsum([len(s) for s in sets]))), y

    m = toxicity_fm.fit(*made(4000, 1), size=256)
    slots, starts, y = made(1000, 2)
    assert ((m.score(slots, starts) >= 0.5) == (y == 1)).mean() > 0.75


def test_ogg(spark, odd, none):
    for n in (0, 1, 63, 64, 2048, 70_000, 300_001):
        raw = random.Random(n).randbytes(n)
        payload = raw + bytes(-n % 64 or 64 * (not n))
        data = ogg_media.mux(payload, n)
        streams, bad = ogg_media.demux(data)
        main = ogg_media.sample_stream(streams)
        assert not bad and len(streams) == 2 and b"".join(main.packets[1:]) == payload
        assert ogg_media.timestamps(main) == [i * ogg_media.PACKET / ogg_media.RATE for i in range(len(main.packets) - 1)]
        broken = bytearray(data)
        broken[-1] ^= 1
        assert ogg_media.demux(bytes(broken))[1] > 0
    assert ogg_media.demux(b"") == ([], 0) and ogg_media.page_crc(b"123456789") == 0x89A1897F
    got = ogg_media.media_features(odd).collect()
    for r, want in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_bytes)), sorted(ODD, key=lambda r: (r[0] is None, r[0] or 0))):
        raw = (want[1] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert ogg_media.media_features(none).count() == 0
    media = ogg_media.encode(odd.where("doc_id = 7"), F.col("doc_id").alias("id"))
    assert ogg_media.packets(media.select("id", "media")).where("start_seconds is not null").count() == -(-180032 // ogg_media.PACKET)


def test_sharding(spark, docs, odd, none, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "t"), least_bytes=1 << 30)
    assert store.append(none) == 0
    for part in range(4):
        store.append(docs.where(F.col("doc_id") % 4 == part))
    before = store.version()
    assert before == 4 and store.compact() == 5 and len(store.runs()) == 1
    assert store.read(before).count() == store.read().count() == docs.count()
    with pytest.raises(Exception, match="AlreadyExists"):
        store.commit([], 4)
    store.vacuum()
    assert store.read().exceptAll(docs).isEmpty() and docs.exceptAll(store.read()).isEmpty()
    other = sharding.ShardStore(spark, str(tmp_path / "u"))
    other.append(odd, F.coalesce("source", F.lit("none")))
    assert other.read().columns == odd.columns and other.read().exceptAll(odd).isEmpty() and len(other.runs()) == 4


def test_sharding_keeps_every_column(spark, tmp_path):
    """A user's own _arrival, values that are no paths, and runs of different columns."""
    store = sharding.ShardStore(spark, str(tmp_path / "v"), least_bytes=1 << 30, fan_in=2)
    first = spark.createDataFrame([(1, "a/b c%"), (2, None)], "id int, _arrival string")
    store.append(first, F.col("_arrival"))
    assert store.read().exceptAll(first).isEmpty() and store.read().count() == 2
    store.append(spark.createDataFrame([(3, 1.5)], "ID int, extra double"))
    want = {(1, "a/b c%", None), (2, None, None), (3, None, 1.5)}
    assert {tuple(r) for r in store.read().collect()} == want and store.read().columns == ["id", "_arrival", "extra"]
    store.compact()
    assert {tuple(r) for r in store.read().collect()} == want and len(store.runs()) == 1
    with pytest.raises(ValueError, match="column id"):
        store.append(spark.createDataFrame([("x",)], "id string"))
    assert store.read().count() == 3


def test_simhash(spark, docs, odd, none):
    def brute(rows):
        fps = {i: simhash_dedup.fingerprint(r[1] or "") for i, r in enumerate(rows)}
        root = list(range(len(rows)))

        def up(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in fps:
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    root[up(i)] = up(j)
        groups = defaultdict(list)
        for i in fps:
            groups[up(i)].append(rows[i][0])
        least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
        return sorted((str(r[0]), f"{fps[i]:016x}", str(least[up(i)])) for i, r in enumerate(rows))

    for frame in (docs, odd):
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_dedup.near_groups(frame).collect())
        assert got == brute(rows)
    assert simhash_dedup.near_groups(none).count() == 0 and simhash_dedup.dedup(odd).columns == odd.columns


def test_links_are_complete(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(8))) for b in base for _ in range(25)}
    want = {(min(a, b), max(a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 4}
    nodes = spark.createDataFrame([(simhash_dedup.signed(x),) for x in fps], "fp bigint")
    for blocks in (6, 7, 8):
        rows = [(r.a % 2**64, r.b % 2**64) for r in simhash_dedup.links(nodes, blocks=blocks).collect()]
        assert len(rows) == len(want) and {(min(r), max(r)) for r in rows} == want


def test_exact(spark, odd, none):
    got = sorted(exact_dedup.groups(odd).toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False), key=str)
    by = defaultdict(list)
    for r in ODD:
        by[hashlib.sha256((r[1] or "").encode()).hexdigest()].append(r[0])
    for r in got:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((x for x in ids if x is not None), default=None)
    assert len(got) == len(ODD) and exact_dedup.groups(none).count() == 0
    for counters in (2, 1024):
        kept = exact_dedup.dedup(odd, counters=counters)
        assert kept.columns == odd.columns and sorted(r.text or "" for r in kept.collect()) == sorted({r[1] or "" for r in ODD})


def test_misra_gries_bound():
    rng, k, held, total = random.Random(1), 8, {}, Counter()
    for _ in range(50):
        batch = Counter(rng.choice("abc" + "".join(map(chr, range(200, 400)))) for _ in range(100))
        total += batch
        held = exact_dedup.reduce_counters(dict(Counter(held) + batch), k)
    assert all(held.get(x, 0) >= n - sum(total.values()) / (k + 1) for x, n in total.items()) and len(held) <= k


def test_pitman_yor(spark, docs, odd, none):
    got = {r.doc_id: r for r in pitman_yor.language_scores(docs, labelled.fold(7, 2)).collect()}
    words = {r.doc_id: (r.text or "").encode().lower().split() + [b""] for r in docs.collect()}
    seen = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(seen.values()), len(seen)
    for d, ws in words.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in seen for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws)) and r.score < 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    small = {r.doc_id: r.score for r in pitman_yor.language_scores(docs, labelled.fold(7, 2), chunk_tokens=5000).collect()}
    assert sum(small.values()) == pytest.approx(sum(r.score for r in got.values()), rel=0.01)
    assert pitman_yor.language_scores(odd, labelled.fold(7, 2)).count() == len(ODD)
    assert pitman_yor.language_scores(none, labelled.fold(7, 2)).count() == 0
    assert pitman_yor.language_scores(odd, F.lit(True)).where("score < 0 or n_tokens > 0").count() == len(ODD)


def test_probabilities_sum_to_one():
    """Over all known words and the unknown one, in any restaurant."""
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 50 * pitman_yor.CONTEXTS, 3000))
    counts = rng.integers(1, 9, len(pairs))
    words, per_word = np.unique(pairs // pitman_yor.CONTEXTS, return_counts=True)
    s = pitman_yor.Seating(words.astype(np.uint64), per_word.astype(np.uint16), (pairs % pitman_yor.CONTEXTS).astype(np.uint16), counts)
    d, base = (0.5, 0.6, 0.7), 1 / (len(words) + 1)
    for i in range(3):
        s.sweep(i, s.totals(), d, base)
    all_ = s.totals()
    own0, own1, own2 = s.own(all_, d)
    back0, back1, back2 = pitman_yor.backing(all_, d)
    for c in (int(s.context[0]), 5):
        total = own2[s.context == c].sum() + back2[c] * (own1[s.parent == c // pitman_yor.CHILDREN].sum() + back1[c // pitman_yor.CHILDREN] * (own0.sum() + back0))
        assert total == pytest.approx(1)


def test_html(spark, none):
    page = """<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><header>Site</header><div class="cookie-notice">We use cookies here, a long text about them.</div>
      <article><header><h1>Head &amp; tail</h1></header><p>First   paragraph<br>goes on.<p>Short.</p><script>var a = "<p>no</p>";</script><div class="share">Share!</div><p>Last one &#233;.</p></article>
      <section id="comments"><p>A reader says a lot of things here.</p></section><form><input><p>Sign up</p></form><footer>Legal</footer></body></html>"""
    want = "Head & tail\nFirst paragraph goes on.\nShort.\nLast one é."
    assert html_text.main_text(page) == want
    plain = page.replace("<article>", "<div>").replace("</article>", "</div>").replace("<header><h1>", "<h1>").replace("</h1></header>", "</h1>")
    assert html_text.main_text(plain) == want
    assert html_text.main_text("<ul><li><a href=x>only links</a><li><a href=y>here</a></ul>") == ""
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>a < b & c"), (5, "x", "<nav>only")], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in html_text.extract(rows).collect()}
    assert got[1].text == want and got[1].n_chars == len(want) and got[2].text == got[3].text == "" and got[4].text == "a < b & c"


def test_mixing(spark, docs, odd, none):
    rows = mixing.placements(docs, block_rows=2, cycle=40).collect()
    assert len({(r.source, r.source_rank) for r in rows}) == docs.count()
    blocks = sorted({(r.slot, r.source, r.block, r.release, r.due) for r in rows})
    assert len({b[0] for b in blocks}) == len(blocks) and all(r[3] <= r[0] < r[4] for r in blocks)
    weights = {r.source: r.n**0.5 for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}
    left = Counter(b[1] for b in blocks)
    done, at = Counter(), {b[0]: b[1] for b in blocks}
    for t in range(1, blocks[-1][0] + 2):  # from the target itself, while every source has rows
        done[at.get(t - 1)] += 1
        if any(done[s] == left[s] for s in weights):
            break
        assert all(abs(done[s] - w * t / sum(weights.values())) < 1 for s, w in weights.items())
    assert t > 40
    mixed = mixing.mix(odd, block_rows=1, cycle=4)
    assert mixed.columns == odd.columns and mixed.exceptAll(odd).isEmpty() and odd.exceptAll(mixed).isEmpty()
    assert mixing.placements(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixing_keeps_to_any_target(spark):
    """Small and odd weights over many cycles, against a plain simulation."""
    rng = random.Random(4)
    for n, cycle in ((2, 8), (7, 16), (12, 64)):
        given = [rng.random() ** 3 + 4e-4 for _ in range(n)]
        sizes = spark.createDataFrame([(f"s{i:02}", 200) for i in range(n)], "source string, rows bigint")
        weight = F.create_map(*[F.lit(x) for i, w in enumerate(given) for x in (f"s{i:02}", w)])[F.col("source")]
        target = mixing.targets(sizes, 1, weight, cycle)
        found = {r.slot: r for r in mixing.timetable(target).collect()}
        assert len(found) == 200 * n
        t = target.first()
        cycle = t.slots
        w, total, done = [x.w for x in t.s], t.total, [0] * n
        for slot in range(max(found) + 1):
            end, last = (slot // cycle + 1) * cycle, []
            rest = sorted(range(n), key=lambda i: (-(w[i] * end % total), i))[: end - sum(x * end // total for x in w)]
            last = [min(200, w[i] * end // total + (i in rest)) for i in range(n)]
            ready = [(min(end, -(-(done[i] + 1) * total // w[i])), i) for i in range(n) if done[i] < last[i] and done[i] * total // w[i] <= slot]
            assert (slot in found) == bool(ready)
            if ready:
                i = min(ready)[1]
                r = found[slot]
                assert (r.source, r.block) == (f"s{i:02}", done[i]) and r.release <= slot < r.due
                done[i] += 1
            if max(done) < 200:
                assert all(abs(d - x / sum(given) * (slot + 1)) < 1 for d, x in zip(done, given))


def test_cycles_join_without_a_missed_window():
    """The rule of the largest remainder over many weights, by itself."""
    rng = random.Random(9)
    for _ in range(150):
        n, cycle = rng.randint(2, 25), rng.choice([5, 16, 40])
        w = [int((rng.random() ** 3 + 0.01) * 10**6) for _ in range(n)]
        total, done = sum(w), [0] * n
        cycle = max(cycle, -(-total // min(w)))
        for slot in range(cycle * 3):
            end = (slot // cycle + 1) * cycle
            rest = sorted(range(n), key=lambda i: (-(w[i] * end % total), i))[: end - sum(x * end // total for x in w)]
            ready = [(min(end, -(-(done[i] + 1) * total // w[i])), i) for i in range(n) if done[i] < w[i] * end // total + (i in rest) and done[i] * total // w[i] <= slot]
            due, i = min(ready)
            assert due > slot
            done[i] += 1
            assert all(abs(d * total - x * (slot + 1)) < total for d, x in zip(done, w))


def test_mix_keeps_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "x", "en", "a", 1)] * 40 + [(None, "y", None, None, 1)] * 3 + [(2, "", "en", "b", 0)], SCHEMA)
    mixed = mixing.mix(rows, block_rows=2, weight=F.when(F.col("source") == "a", -1.0))
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, rows.collect()))


def test_mix_order_reaches_the_sequences(spark):
    """Over several partitions and files, of which Spark reads the largest first."""
    import corpus_pipeline as P

    rows = [(i, f"word{i} " * (1 + i * i % 97), "en", "abbccccdddddddd"[i % 15], 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for key, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.files.maxPartitionBytes", "20000"), ("spark.sql.files.openCostInBytes", "0")):
        spark.conf.set(key, value)
    try:
        mixed = mixing.mix(docs, block_rows=1)
        want = [r.doc_id for r in mixing.placements(docs, block_rows=1).orderBy("slot", "source_rank").collect()]
        again = P.stored(mixed, "mixing")
        assert len(again.inputFiles()) > 1
        pieces = P.packed(spark, again, SF).orderBy("sequence_id", "offset").collect()
    finally:
        for key in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(key)
    assert list(dict.fromkeys(r.doc_id for r in pieces)) == want


def test_pipeline(spark):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    out = P.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame, kept = docs, {}
    for name, stage in P.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        frame = spark.createDataFrame(frame.collect(), docs.schema)
        kept[name] = {r.doc_id for r in frame.collect()}
        assert frame.columns == docs.columns
    assert kept["exact_dedup"] <= kept["quality"] and kept["near_dedup"] <= kept["exact_dedup"] and kept["mixing"] == kept["near_dedup"] == {r.doc_id for r in out}
    order = list(dict.fromkeys(r.doc_id for r in sorted(out, key=lambda r: (r.sequence_id, r.offset))))
    assert order == [r.doc_id for r in frame.collect()]
    library, texts = Tokenizer.from_file(tokenizer_path()), {r.doc_id: r.text for r in frame.collect()}
    for doc_id in order:  # every kept text is covered once, from end to end
        ids = np.array(library.encode(texts[doc_id], add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted((r for r in out if r.doc_id == doc_id), key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, odd, none):
    import corpus_pipeline as P

    marks = spark.createDataFrame([(4, 1, 0), (1, None, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for name, frame in (("odd", odd), ("none", none)):
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
        marks.write.parquet(str(tmp_path / name / "labels.parquet"))
        ids = {r.doc_id for r in P.run(spark, str(tmp_path / name)).collect()}
        assert ids == (set() if name == "none" else {2, 5, 7, 8, None})


def test_pitman_yor_does_not_change_with_the_session(spark, docs):
    scores = []
    for partitions, chunk, split, fan in (("4", 4_000_000, 64 << 20, 128), ("9", 2000, 5000, 2)):  # the second deals every bucket to several tasks
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = pitman_yor.language_scores(docs, labelled.fold(7, 2), chunk_tokens=chunk, bucket_bytes=1 << 14, split_bytes=split, fan=fan)
        scores.append({r.doc_id: r.score for r in got.collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert scores[0] == pytest.approx(scores[1], rel=1e-6) and len(scores[0]) == docs.count()


def naive_scores(texts, training, sweeps=pitman_yor.SWEEPS):
    """The model by dictionaries and one customer at a time, for counts below EXACT."""
    P, key = pitman_yor, lambda x: np.array([x], np.uint64)
    digest = lambda w: P.xxhash.xxh64_intdigest(w, 0)
    pairs = [[(w, P.context_of(v)) for v, w in zip([b"", *t], t)] for t in texts]
    c2 = Counter(x for p, t in zip(pairs, training) if t for x in p)
    t2 = {x: 1 for x in c2}
    up1 = lambda t: Counter({y: sum(n for (w, c), n in t.items() if (w, c // P.CHILDREN) == y) for y in {(w, c // P.CHILDREN) for w, c in t}})
    up0 = lambda t: Counter({w: sum(n for (v, _), n in t.items() if v == w) for w in {v for v, _ in t}})
    c1 = up1(t2)
    t1 = {x: 1 for x in c1}
    c0 = up0(t1)
    t0 = {x: 1 for x in c0}
    base = 1 / (len(c0) + 1)
    d = [min(0.95, max(0.05, (v := list(c.values())).count(1) / max(1, v.count(1) + 2 * v.count(2)))) for c in (c0, c1, c2)]

    def sums(c, r):
        got = Counter()
        for x, n in c.items():
            got[r(x)] += n
        return got

    def probability(state, w, c):
        c0, t0, c1, t1, c2, t2, n0, m0, n1, m1, n2, m2 = state
        p = (c0.get(w, 0) - d[0] * t0.get(w, 0) + (P.STRENGTH + d[0] * m0) * base) / (P.STRENGTH + n0)
        y = (w, c // P.CHILDREN)
        p1 = (c1.get(y, 0) - d[1] * t1.get(y, 0) + (P.STRENGTH + d[1] * m1[y[1]]) * p) / (P.STRENGTH + n1[y[1]])
        return p, p1, (c2.get((w, c), 0) - d[2] * t2.get((w, c), 0) + (P.STRENGTH + d[2] * m2[c]) * p1) / (P.STRENGTH + n2[c])

    def state():
        r = lambda x: x[1]
        return (dict(c0), dict(t0), dict(c1), dict(t1), c2, dict(t2), sum(c0.values()), sum(t0.values()), sums(c1, r), sums(t1, r), sums(c2, r), sums(t2, r))

    def seat(k, n, weight, discount):
        tables = min(n, 1)
        for seated in range(1, n):
            tables += int(P.uniform(k, seated)[0] * (weight + seated - discount * tables) < weight)
        return tables

    scramble = P.scrambled
    total = [np.zeros(len(p)) for p in pairs]
    for sweep in range(sweeps):
        s, one = state(), np.uint64(sweep)
        t2 = {(w, c): seat(scramble(scramble(key(digest(w)) ^ scramble(key(c + 1))) + one), n, (P.STRENGTH + d[2] * s[11][c]) * probability(s, w, c)[1], d[2]) for (w, c), n in c2.items()}
        c1 = up1(t2)
        t1 = {(w, y): seat(scramble(scramble(key(digest(w)) ^ scramble(key(y + (1 << 32)))) + one), n, (P.STRENGTH + d[1] * s[9][y]) * probability(s, w, y * P.CHILDREN)[0], d[1]) for (w, y), n in c1.items()}
        c0 = up0(t1)
        t0 = {w: seat(scramble(scramble(key(digest(w))) + one), n, (P.STRENGTH + d[0] * s[7]) * base, d[0]) for w, n in c0.items()}
        now = state()
        total = [a + [probability(now, w, c)[2] for w, c in p] for a, p in zip(total, pairs)]
    return [float(np.log10(x / sweeps).sum()) for x in total]


def test_scores_equal_a_naive_model(spark):
    rng, words = random.Random(6), "the of and a river stone bridge Über it's walking walked talk over under".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25))), "en", "a", 0) for i in range(20)]
    got = {r.doc_id: r for r in pitman_yor.language_scores(spark.createDataFrame(rows, SCHEMA), labelled.fold(7, 2)).collect()}
    texts = [r[1].encode().translate(pitman_yor.LOWER).split() + [b""] for r in rows]
    training = [not got[r[0]].held_out for r in rows]
    assert [got[r[0]].score for r in rows] == pytest.approx(naive_scores(texts, training), rel=1e-5)


def test_lookup_score_is_a_sum_of_entries():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(400, len(quality_gam.FEATURES))), rng.integers(0, 2, 400).astype(float)
    model = quality_gam.fit(x, y)
    for row, got in zip(x[:50], model.score(x)):
        total = model.bias + sum(t[sum(e <= v for e in edges)] for t, edges, v in zip(model.tables, model.edges, row))
        for (a, b), t in zip(model.pairs, model.pair_tables):
            total += t[sum(e <= row[a] for e in model.pair_edges[a]), sum(e <= row[b] for e in model.pair_edges[b])]
        assert got == pytest.approx(1 / (1 + math.exp(-total)))


def test_trees_find_the_best_cuts():
    rng = np.random.default_rng(8)
    gain = lambda g, h: g.sum() ** 2 / (h.sum() + quality_gam.RIDGE)
    for _ in range(20):
        g, h = rng.normal(size=9), rng.random(9)
        best = max(gain(g[:c], h[:c]) + gain(g[c:], h[c:]) for c in range(1, 9))
        tree = quality_gam.tree_1d(g, h, leaves=2)
        parts = [tree == v for v in np.unique(tree)]
        assert sum(gain(g[p], h[p]) for p in parts) == pytest.approx(max(best, gain(g, h)) if len(parts) > 1 else gain(g, h))
        g, h = rng.normal(size=(5, 4)), rng.random((5, 4))
        cells = lambda x, i, j: [x[:i, :j], x[:i, j:], x[i:, :j], x[i:, j:]]
        found = max((sum(map(gain, cells(g, i, j), cells(h, i, j))), i, j) for i in range(1, 5) for j in range(1, 4))
        values, best = quality_gam.tree_2d(g, h)
        assert best == pytest.approx(found[0])
        for part, a, b in zip(cells(values, *found[1:]), cells(g, *found[1:]), cells(h, *found[1:])):
            assert np.allclose(part, a.sum() / (b.sum() + quality_gam.RIDGE))


def test_pair_sum_equals_a_double_loop():
    rng = np.random.default_rng(5)
    m = toxicity_fm.Machine(0.3, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32))
    sets = [np.sort(rng.choice(50, n, replace=False)) for n in (0, 1, 2, 7, 20, 0)]
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    got = m.margin(np.concatenate(sets), starts)[0]
    for s, value in zip(sets, got):
        pairs = sum(float(m.v[i].astype(float) @ m.v[j].astype(float)) for k, i in enumerate(s) for j in s[:k])
        assert value == pytest.approx(0.3 + m.w[s].astype(float).sum() + pairs, rel=1e-4, abs=1e-4)
    alone = np.concatenate([m.margin(s, np.array([0, len(s)]))[0] for s in sets])
    assert (alone == got).all()  # whatever the batch


LONG = "<p>" + "word " * 60 + "</p>"


@pytest.mark.parametrize("page,first,last", [
    (f'<div class="layout has-sidebar"><article><h1>T</h1>{LONG}</article></div>', "T", "word"),
    (f'<nav><a href=x>Home</a></nav><div class="content no-comments"><h1>T</h1>{LONG}{LONG}<p>End.</p></div><footer>Legal</footer>', "T", "End."),
    (f'<article><h1 class="entry-header">T</h1>{LONG}<section id="related-work"><p>Old work.</p></section></article>', "T", "work."),
    (f'<form id=page><nav><a>m</a></nav><article><h1>T</h1>{LONG}</article><footer>f f f</footer></form>', "T", "word"),
    (f'<div><h1>T</h1>{LONG}{LONG}</div><article><a href=x>teaser one with a long text</a></article><article><a href=x>other</a></article>', "T", "word"),
    (f'<p class=notice>Note this<p>First words.</p>{LONG}<p>x</p>', "First", "x"),
    ('<nav><a>x</a></nav><div class="ad">Some words of an advert, rather more than the text.</div><article><h1>A</h1><p>B</article><footer>&copy; more words than the text has.</footer>', "A", "B"),
    (f'<article>{LONG}<div id="comments"><article class="comment"><p>A reader says a thing.</p></article></div></article>', "word", "word"),
])
def test_html_wrappers(page, first, last):
    words = html_text.main_text(page).split()
    assert (words[0], words[-1]) == (first, last)


def test_line_windows_by_brute_force(spark):
    rng = random.Random(2)
    for _ in range(50):
        w, k, least = [rng.choice([0, 0, 5, 40, 300]) for _ in range(rng.randint(0, 15))], rng.randint(1, 5), 45
        sums = [min(sum(w[i : i + k]), sum(w[max(0, i - k + 1) : i + 1])) for i in range(len(w))]
        assert html_text.window_sums(w, k) == sums
        inside = [i for a, b in html_text.stretches(sums, least) for i in range(a, b)]
        assert inside == [i for i, v in enumerate(sums) if v >= least]
    # on the pages themselves the windows decide: kept lines are those between the points
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    changed = 0
    for r in rows:
        lines, _ = html_text.lines_of(r.html)
        changed += html_text.main_text(r.html) != "\n".join(x.text for x in lines)
        assert html_text.main_text(r.html) in "\n".join(x.text for x in lines)
    assert changed == len(rows)


@pytest.mark.parametrize("unit", ['<a "', '<a ="', "<a ='>", "<div class=ad>", "</b><i>", "<svg>", "<!--", "<li><b>", "<p class=notice>x", "<", "&#"])
def test_malformed_pages_take_linear_time(unit):
    import time

    begin = time.perf_counter()
    html_text.main_text(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - begin < 5  # about a second; quadratic scanning takes many minutes


def test_order_of_a_write_whatever_the_names(spark, tmp_path):
    """Columns named like those that the order needs, or like Spark's own."""
    from helixloom.llm.common import as_written

    rows = spark.range(400).repartition(7).selectExpr("id as _part", "'f' as _file", "2 as _row", "named_struct('file_name', 'mine', 'row_index', 3L) as _metadata", "id as row", "'x' as `order`", "id as `a.b`")
    rows.write.parquet(str(tmp_path / "t"))
    got = as_written(spark.read.parquet(str(tmp_path / "t")))
    assert got.columns == rows.columns
    files = sorted((tmp_path / "t").glob("part-*"))
    import pyarrow.parquet as pq

    assert [r.row for r in got.collect()] == [x for f in files for x in pq.read_table(f)["row"].to_pylist()]
    assert {r._metadata.file_name for r in got.collect()} == {"mine"}
    assert as_written(spark.range(3)).count() == 3


def test_pipeline_with_clashing_names(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as _part", "2 as _file", "3 as _row", "named_struct('a', 4) as _metadata")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or after.columns == docs.columns
        docs = after
    assert docs.count()


def test_sample_is_stable_where_ids_repeat(spark):
    docs = spark.range(300).selectExpr("id % 100 as doc_id", "concat('text ', id) as text")
    labels = spark.range(100).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    take = lambda d: sorted(map(tuple, labelled.sample(d, labels, "quality", F.lit(False), 40).collect()))
    first = take(docs.repartition(5))
    assert first == take(docs.repartition(9, "text")) and len(first) == 40


#: Pages whose furniture has no mark: only where their lines lie tells.
UNMARKED = [
    ("<body><div>" + "".join(f"<div><a href=x>Go {i}</a></div>" for i in range(9)) + "</div><div>" + "".join(f"<p>Sentence {i} of the main text, which goes on for a good while longer than others.</p>" for i in range(6)) + "</div><div><div>Call us</div><div>Terms</div></div></body>", 6),
    ("<body><div><div>Home</div><div>Deals</div></div><section>" + "".join(f"<p>Paragraph {i} tells what happened on that day at some length, with names and places.</p>" for i in range(4)) + "</section><div>" + "".join(f"<div>x{i}</div>" for i in range(12)) + "</div></body>", 4),
]


def test_windows_decide_where_nothing_is_marked():
    """Without windows the same lines and marks would keep the furniture."""
    for page, n in UNMARKED:
        lines, marks = html_text.lines_of(page)
        left = html_text.effective(marks)
        unmarked = "\n".join(x.text for x in lines if left[x.mark] == 1)
        got = html_text.main_text(page)
        assert len(got.split("\n")) == n and got != unmarked and len(unmarked.split("\n")) > n


def plain_text(page, window=html_text.WINDOW, least_sum=html_text.THRESHOLD):
    """The extraction from lines and marks by its definition: every window is
    summed anew, and kept lines are looked for one by one."""
    lines, marks = html_text.lines_of(page)
    left = html_text.effective(marks)
    n, plain = len(lines), [x.free * left[x.mark] for x in lines]
    total, inside = sum(plain), sum(p for p, x in zip(plain, lines) if x.holder)
    article = inside > total / 2 or total == 0 and any(x.holder for x in lines)
    if article:
        weight = [p + (least_sum if left[x.mark] == 1 else 0) if x.holder else p / 10 for p, x in zip(plain, lines)]
    else:
        weight = [p + (least_sum if left[x.mark] == 1 and p > 0 and x.tag in html_text.HEADINGS else 0) for p, x in zip(plain, lines)]
    if not any(weight):
        return ""
    value = [min(sum(weight[i : i + window]), sum(weight[max(0, i + 1 - window) : i + 1])) for i in range(n)]
    level = min(least_sum, max(value) / 4) or 1e-9
    dense = [v >= level for v in value]
    if not any(dense):
        dense[weight.index(max(weight))] = True
    spans = []
    for i in range(n):
        if dense[i]:
            spans = [*spans[:-1], (spans[-1][0], i)] if spans and spans[-1][1] == i - 1 else [*spans, (i, i)]
    size = lambda s: sum(plain[s[0] : s[1] + 1])
    most = max(map(size, spans))
    spans = [s for s in spans if size(s) >= most / 4]
    kept = set()
    for a, b in spans:
        kept |= set(range(a, b + 1))
    for (_, b), (c, _) in zip(spans, spans[1:]):
        if lines[b].holder and lines[b].holder == lines[c].holder:
            kept |= set(range(b, c))
    out = set(kept)
    for edge, step in [(i, -1) for i in kept if i - 1 not in kept] + [(i, 1) for i in kept if i + 1 not in kept]:
        j, e = edge + step, lines[edge]
        while 0 <= j < n and lines[j].parent == e.parent and (left[lines[j].mark] < 1 or lines[j].tag in {e.tag, "p", *html_text.HEADINGS}):
            out.add(j)
            j += step
    return "\n".join(lines[i].text for i in sorted(out) if left[lines[i].mark] == 1)


def test_extraction_by_brute_force(spark):
    rng = random.Random(9)
    pages = [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()] + [p for p, _ in UNMARKED]
    for _ in range(200):
        body = "".join(
            f"<{t}{rng.choice(['', '', ' class=sidebar', ' id=main'])}>" + "word and more " * rng.choice([0, 1, 2, 9, 20]) + rng.choice(["", "<a href=x>link link</a>"]) + rng.choice([f"</{t}>", f"</{t}>", ""])
            for t in rng.choices(["p", "div", "h2", "li", "section", "article", "nav", "td"], k=rng.randrange(0, 25))
        )
        pages.append(f"<body>{body}</body>")
    for page in pages:
        assert html_text.main_text(page) == plain_text(page)


def test_pages_with_clashing_names_and_repeats(spark):
    rows = [(1, "u", UNMARKED[0][0]), (1, "u", UNMARKED[0][0]), (None, None, None), (2, "v", ""), (3, "w", "<p>&amp; x</p>" * 3000)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = html_text.extract(frame).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == sorted((str(i), len(html_text.main_text(h or ""))) for i, _, h in rows)
