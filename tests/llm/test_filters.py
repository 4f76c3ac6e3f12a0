"""URL filters, decontamination, mixing, extraction, sharding and quality."""

import datetime as dt
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastack.llm import decontaminate, gbt, hilbert, html_extract, html_tree, mixing, quality, url_filter
from tests.llm.conftest import prose


def test_urls(spark):
    day = lambda n: dt.date(2024, 1, n)
    entries = spark.createDataFrame([("bad.com", day(5), "block"), ("bad.com", day(10), "unblock"), ("a.ok.com/x", day(1), "block"), ("same.com", day(3), "block"), ("same.com", day(3), "unblock"), (None, day(1), "block"), ("late.com", None, "block")], "key string, day date, action string")
    rows = [("http://bad.com/1", day(4)), ("http://bad.com/1", day(5)), ("https://u:p@www.BAD.com:80/q?x=1", day(9)), ("http://bad.com", day(10)), ("http://a.ok.com/x/y", day(2)), ("http://a.ok.com/z", day(2)), ("http://same.com", day(4)), ("no url", day(9)), (None, day(9)), ("http://bad.com", None), ("http://late.com", day(9))]
    df = spark.createDataFrame(rows, "url string, fetched date").withColumns({"key": F.lit(1), "spans": F.lit(2), "blocked": F.lit("x")})
    got = url_filter.filtered(df, entries)
    assert [r.blocked for r in got.collect()] == [False, True, True, False, True, False, False, False, False, False, False]
    assert got.columns == ["url", "fetched", "key", "spans", "n_active", "blocked"]
    assert url_filter.filtered(df, entries.limit(0)).where("blocked").isEmpty() and url_filter.filtered(df.limit(0), entries).isEmpty()


def brute_active(url, day, entries):
    """Entries of the list that hold for a URL on a day, one by one."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    if not m or not m[1] or day is None:
        return 0
    own, path = m[1].lower(), re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", url)[1] or ""
    n = 0
    for key in {e[0] for e in entries if e[0] is not None}:
        domain, slash, steps = key.partition("/")
        if not (own == domain or own.endswith("." + domain)) or slash and not (path == "/" + steps or path.startswith("/" + steps + "/")):
            continue
        past = [(d, a) for k, d, a in entries if k == key and d is not None and d <= day]
        n += bool(past) and max((d, a) for d, a in past)[1] == "block"
    return n


@pytest.mark.parametrize("broadcast", [True, False])
def test_urls_equal_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        from terrastack.llm import staging

        monkeypatch.setattr(staging, "BROADCAST_BYTES", -1)
    rng = random.Random(4)
    name = lambda n: ".".join(rng.choice("abc") for _ in range(rng.randint(1, n)))
    steps = lambda n: "".join("/" + rng.choice(["x", "y", "z.html"]) for _ in range(rng.randint(0, n)))
    day = lambda: dt.date(2024, 1, rng.randint(1, 28))
    entries = [(name(4) + steps(3), day(), rng.choice(["block", "block", "unblock"])) for _ in range(60)]
    urls = [(f"http://{name(6)}.c{rng.choice(['', ':80'])}{steps(5)}{rng.choice(['', '/', '?q=/x', '#/x'])}".replace(".c", rng.choice(["", ".c"]), 1), day()) for _ in range(400)]
    urls += [("http://" + "a." * 300 + "b" + "/x" * 3000, day()), ("http://a..b/x//y", day()), ("ftp://A.B/X", day()), ("http://", day())]
    urls += urls[:5]
    df = spark.createDataFrame(urls, "url string, fetched date").withColumn("same_url", F.lit("mine"))
    got = url_filter.filtered(df, spark.createDataFrame(entries, "key string, day date, action string"))
    want = sorted((u, d, brute_active(u, d, entries)) for u, d in urls)
    assert sorted((r.url, r.fetched, r.n_active) for r in got.collect()) == want and sum(w[2] > 0 for w in want) > 50
    assert {r.same_url for r in got.collect()} == {"mine"}


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(8)
    items = [prose(rng, 30) for _ in range(12)]
    clean = [prose(rng, 80) for _ in range(40)]
    edited = items[1].split()
    for i in (4, 11, 19, 25):
        edited[i] = "other"
    dropped = [w for i, w in enumerate(items[2].split()) if i not in (7, 8, 20)]
    texts = [*clean, clean[0] + " " + items[0].upper() + ". " + clean[1], clean[2] + " " + " ".join(edited), clean[3] + " " + ", ".join(dropped) + " " + clean[4], prose(rng, 30000) + " " + items[3] + " end", *[prose(rng, 20) + " " + items[4] for _ in range(30)], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumns({"item_id": F.lit("x"), "score": F.lit(0)})
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "three short words"), (None, items[5]), (1, items[1])], "item_id long, text string")
    return docs, bench


def test_leaks_are_found_and_clean_documents_are_not(leaky):
    docs, bench = leaky
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(40, 0), (41, 1), (42, 2), (43, 3), *((44 + i, 4) for i in range(30))}
    assert decontaminate.contaminated(docs, bench).count() == len(got)
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {*range(40), 74, 75}


def test_edited_copies_are_found_however_common(spark):
    """The grams that the edited copies keep are common, those they lost occur once."""
    rng = random.Random(12)
    item = prose(rng, 30).split()
    passage = " ".join("other" if i % 5 == 4 else w for i, w in enumerate(item))
    texts = [" ".join(item), *[prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(20)], *[prose(rng, 60) for _ in range(20)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()} == set(range(21))


def plain_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else decontaminate.MISMATCH), h[i, j + 1] + decontaminate.GAP, h[i + 1, j] + decontaminate.GAP)
    return h.max()


def test_found_pairs_equal_brute_force(spark, monkeypatch):
    """Every pair of a text and an item by plain Smith-Waterman over the whole text, with a 4-gram in common; short items by copies."""
    rng = random.Random(21)
    word = lambda: rng.choice("abcdefgh")  # noqa: E731  few words: many seeds, and scores on both sides of the limit
    items = [[word() for _ in range(rng.randint(8, 16))] for _ in range(10)] + [["one", "two", "three"], ["h", "a", "h"], ["zz"]]
    texts = []
    for _ in range(70):
        text = [word() + rng.choice(["", "x", "y"]) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            at, item = rng.randint(0, len(text)), list(rng.choice(items))
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(item) + 1)
                item[k : k + rng.randint(0, 1)] = ["q"] * rng.randint(0, 2)
            text[at:at] = item
        texts.append(text)
    texts += [["one", "two", "three"], ["one", "two", "x", "three"], ["ZZ"]]

    def grams(x, n):
        return {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}

    want = {}
    for d, text in enumerate(texts):
        text = [w.lower() for w in text]
        for i, item in enumerate(items):
            if len(item) < 8:
                if tuple(item) in grams(text, len(item)):
                    want[d, i] = 1.0
            elif grams(text, 4) & grams(item, 4) and (score := plain_score(item, text) / len(item)) >= 0.5:
                want[d, i] = round(score, 6)
    docs = spark.createDataFrame([(d, ", ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    for pairs in (1 << 22, 16):
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        assert {(r.doc_id, r.item_id): round(r.score, 6) for r in decontaminate.contaminated(docs, bench).collect()} == want
    assert 40 < len(want) < 600


def test_no_alignment_scores_more_than_the_words_in_common():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 9, 8).astype(np.uint64), rng.integers(0, 14, (20, 24)).astype(np.uint64)
        assert (decontaminate.align(a, b) <= decontaminate.shared(a, b)).all()


def test_decontamination_in_blocks_and_empty(spark, leaky, monkeypatch):
    docs, bench = leaky
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 700)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == whole
    assert decontaminate.contaminated(docs, bench.limit(0)).isEmpty() and decontaminate.contaminated(docs.limit(0), bench).isEmpty()


def test_alignment_equals_plain_smith_waterman():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.integers(0, 6, 9), rng.integers(0, 6, 14)
        assert abs(decontaminate.align(a, b[None])[0] - plain_score(a, b)) < 1e-5


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full


def brute_mix(rows):
    """Words of each source, targets and copies of each row, by the definition: nearest to the target along the draws."""
    import hashlib

    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    draw = [int(hashlib.md5(("mix|" + (str(i) if i is not None else hashlib.md5((t or "").encode()).hexdigest())).encode()).hexdigest()[:8], 16) for i, t, _ in rows]
    sums = {}
    for n, (_, _, s) in zip(size, rows):
        sums[s] = sums.get(s, 0) + n
    target, out = brute_targets(sums), []
    for s, total in sums.items():
        times = min(3, int(target[s] // total)) if total else 0
        need, upto, cut = target[s] - times * total if times < 3 else 0, 0, -1
        for u in sorted({d for d, r in zip(draw, rows) if r[2] == s}):
            words = sum(n for n, d, r in zip(size, draw, rows) if r[2] == s and d == u)
            upto += words
            if need > 0 and 2 * upto - words <= 2 * need + 1e-6:
                cut = u
        out += [(i, n, total, round(target[s], 6), times + (d <= cut)) for n, d, (i, _, x) in zip(size, draw, rows) if x == s]
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_mixing_equals_brute_force(spark, docs, texts, empty, monkeypatch, broadcast):
    if not broadcast:
        from terrastack.llm import staging

        monkeypatch.setattr(staging, "BROADCAST_BYTES", -1)
    rows = [(i, t, ["a", "b", "c", None][i % 4]) for i, t in enumerate(texts)] + [(None, texts[4], "a"), (None, texts[5], "a"), (7, texts[7], "d"), (7, texts[7], "d"), (900, "", "e"), (901, "w " * 600_000, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    key = lambda r: tuple(map(str, r))
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.copies) for r in mixing.taken(df).collect()]
    assert sorted(got, key=key) == sorted(brute_mix(rows), key=key)
    want = {}
    for row, copies in zip(sorted(brute_mix(rows), key=key), (x[4] for x in sorted(brute_mix(rows), key=key))):
        want[row[0], row[1]] = want.get((row[0], row[1]), 0) + copies
    out = {}
    for r in mixing.mix(df).collect():
        k = r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        out[k] = out.get(k, 0) + 1
    assert out == {k: v for k, v in want.items() if v}
    assert mixing.taken(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mix_keeps_the_columns_of_its_input(spark):
    df = spark.createDataFrame([(i, "a b c", "s", f"mine{i}", 7) for i in range(4)], "doc_id long, text string, source string, size string, copy int")
    df = df.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in ("source_of_target", "target", "source_size", "copies", "mix", "Own", "cut", "times", "u")})
    got = mixing.mix(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_words_come_near_their_targets(spark):
    """Few documents of very different lengths: each source ends within a document of its target."""
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + pow(id % 13, 3) as int))").alias("text"), F.concat(F.lit("s"), (F.col("id") % 20).cast("string")).alias("source"))
    sums = df.select("doc_id", "source").join(mixing.taken(df), "doc_id").groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.max("target").alias("target"), F.max("size").alias("longest"), F.max("copies").alias("most")).collect()
    assert len(sums) == 20 and all(abs(r.words - r.target) <= r.longest / 2 + 1 and r.most <= 3 for r in sums)


def test_targets_are_capped(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_targets({"a": 10, "b": 1000, "c": 0, None: 500})
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want) and got["a"] == 30


def test_hilbert_curve_is_continuous(spark):
    for n, bits in ((2, 4), (3, 3)):
        dims = [f"d{i}" for i in range(n)]
        df = spark.range(1 << (n * bits)).select(*(F.expr(f"cast(shiftright(id, {i * bits}) & {(1 << bits) - 1} as int)").alias(d) for i, d in enumerate(dims)))
        rows = sorted(hilbert.with_curve(df, dims, bits).collect(), key=lambda r: r.curve)
        assert [r.curve for r in rows] == list(range(1 << (n * bits)))
        assert all(sum(abs(a[d] - b[d]) for d in dims) == 1 for a, b in zip(rows, rows[1:]))


def test_shards(spark, docs, texts, empty, tmp_path):
    rows = hilbert.sharded(docs).collect()
    assert len(rows) == len(texts)
    per = {}
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(t) + 8 and r.text_crc32 == zlib.crc32(t) and r.law == "rows" and r.grown_shard is None
        per.setdefault(r.shard, []).append(r.slot)
    assert set(per) == set(range(24)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in rows)
    assert hilbert.sharded(empty).count() == 0
    few = hilbert.sharded(docs.limit(5)).collect()
    assert len({r.shard for r in few}) == 5 and {r.slot for r in few} == {0}


def test_quantised_values_equal_plain_ranks(spark, monkeypatch):
    values = ["é", "b", None, "a", "B", "b", "zz", ""] * 3
    df = spark.createDataFrame([(i, v, i) for i, v in enumerate(values)], "doc_id long, v string, text_crc32 long")
    names = sorted({v for v in values if v is not None}, key=lambda v: v.encode()) + [None]
    for most in (1 << 20, -1):
        from terrastack.llm import staging

        monkeypatch.setattr(staging, "BROADCAST_BYTES", most)
        got = hilbert.ranked_values(df, "v", 2).collect()
        assert len(got) == len(values) and all(r._v == names.index(r.v) * 4 // len(names) for r in got)


def test_written_shards_hold_every_row_once_and_can_be_pruned(spark, docs, texts, tmp_path):
    """Repeated rows, null ids and columns named like the operator's own, value by value."""
    more = spark.createDataFrame([(None, "lost?", None, None, 5)] * 2 + [(3, "x y", "en", "a", 3)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    df = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more).withColumns({"size": F.concat(F.lit("s"), "n_chars"), "rank": F.lit("mine"), "curve": F.lit("mine"), "text_crc32": F.lit("mine")})
    hilbert.write_shards(df, str(tmp_path / "out"), 4, rows=5)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    per = {}
    for r in got.select("shard", "slot", F.input_file_name().alias("file"), "source", "lang").collect():
        per.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in per.values()) and len(per) == 4
    files = {}
    for r in (r for v in per.values() for r in v):
        files.setdefault(r.file, []).append(r)
    assert all(max(r.slot for r in v) - min(r.slot for r in v) == len(v) - 1 <= 4 for v in files.values())  # runs
    for column in ("lang", "source"):  # a filter on any dimension leaves files out
        values = {getattr(r, column) for v in files.values() for r in v}
        opened = [sum(any(getattr(r, column) == x for r in v) for v in files.values()) / len(files) for x in values]
        assert sum(opened) / len(opened) < 0.6, (column, opened)
    whole = hilbert.sharded(df, 4, carry=True)
    assert whole.count() == df.count() and whole.columns == ["doc_id", "text", "lang", "source", "n_chars", "rank", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve"]


def test_trees_learn_and_score_in_blocks():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = gbt.fit(x[:3000], y[:3000])
    p = trees.score(x[3000:])
    assert ((p > 0.5) == (y[3000:] > 0)).mean() > 0.95
    one = np.concatenate([trees.score(r[None]) for r in x[3000:3050]])
    assert np.allclose(one, p[:50])
    assert gbt.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_quality(spark, empty):
    rng = random.Random(1)
    good = [". ".join(prose(rng, 12).capitalize() for _ in range(6)) for _ in range(150)]
    bad = [" ".join(w + rng.choice(["!!", "###", "$$$"]) for w in prose(rng, 60).upper().split()) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(good + bad), (900, None), (901, ""), (902, "x " * 40000), (None, good[0]), (0, good[0])], "doc_id long, text string").withColumns({"score": F.lit(1), "label": F.lit(2), "lang": F.lit("en")})
    labels = spark.createDataFrame([*((i, 1) for i in range(150)), *((150 + i, 0) for i in range(150)), (None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len(held) > 30 and all((r.score > 0.5) == (r.doc_id < 150) for r in held if r.doc_id < 300)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_statistics_do_not_depend_on_neighbours(texts):
    import pyarrow as pa

    from terrastack.llm.textkit import buffer

    whole = quality.statistics(*buffer(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(quality.statistics(*buffer(pa.array([t], pa.string())))[0], whole[i])


PAGE = "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><div class='ad'>Buy this now.</div><article><h1>A &amp; B</h1><p>First   paragraph,\nwith <b>bold text inside it and no end.<br><p>Second &eacute;t&#233; paragraph stands here for long.</p></article><div id='comments'><div class='comment'><p>Nice article, I liked reading it.</p></div></div><footer>&copy; site</footer></body></html>"


@pytest.fixture(scope="module")
def trees():
    return html_extract.train()


def test_main_text(spark, trees):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "no markup at all but text"), (None, "x", "<p>" * 3000 + "deep"), (5, "y", "<!-- " * 200 + "<" * 500 + "<a title=\"x"), (6, "z", "<div>" * 2000 + "words" + "</div>" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(1)})
    got = html_extract.extract(df, trees).collect()
    want = "A & B\nFirst paragraph, with bold text inside it and no end.\nSecond été paragraph stands here for long."
    assert [r.text for r in got if r.page_id == 1] == [want, want] and all(r.n_chars == len(r.text) for r in got)
    assert all(r.text == "" for r in got if r.page_id in (2, 3)) and len(got) == len(rows)
    assert html_extract.extract(df.limit(0), trees).count() == 0


def test_decoding_equals_an_exhaustive_search():
    """Of all choices without a kept node below a dropped one, the decoded one has the largest sum of odds."""
    import itertools

    rng, pages = np.random.default_rng(5), random.Random(5)
    tried = 0
    while tried < 60:
        def tree(depth):
            inner = "".join(tree(depth - 1) for _ in range(pages.randint(0, 3))) if depth else ""
            return f"<div>{'words ' * pages.randint(0, 3)}{inner}</div>"

        _, nodes = html_tree.parse(tree(3))
        if not 4 <= len(nodes) <= 13:
            continue
        tried += 1
        odds = rng.normal(size=len(nodes))
        weight = [odds[i] * (np.log1p(len(x.text)) if x.text else 1) for i, x in enumerate(nodes)]
        legal = [m for m in itertools.product((False, True), repeat=len(nodes)) if all(x.parent is None or not m[i] or m[x.parent.index] for i, x in enumerate(nodes))]
        best = max(legal, key=lambda m: sum(w if k else -w for w, k in zip(weight, m)))
        assert html_extract.decode(nodes, odds).tolist() == [k and bool(x.text) for k, x in zip(best, nodes)]


PARAGRAPH = "A long enough paragraph of main text stands in this article, and it goes on for a while, as such paragraphs do."


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>t</title><article><h1>Head</h1><p>{0}</p></article>",  # implied ends of head and html
        "<head><meta charset=x><article><h1>Head</h1><p>{0}</p></article>",
        "<html><body><article><h1>Head</h1><svg><p>{0}</p></article></body></html>",  # elements that never end
        "<body><article><h1>Head</h1><object data=x><p>{0}</p></article>",
        "<body><article><h1>Head</h1><iframe src=x><p>{0}</p><select></article>",
        "<body><article><h1>Head</h1><svg><text>drawn</text></svg><p>{0}</p></article><script>var x = 1;",
    ],
)
def test_text_is_not_lost_to_unclosed_elements(trees, page):
    assert html_extract.blocks_of(page.format(PARAGRAPH), trees) == ["Head", PARAGRAPH]


def test_formulas_are_text(trees):
    page = f"<body><article><h1>Head</h1><p>{PARAGRAPH} So <math><mi>a</mi><mo>+</mo><mi>b</mi></math> holds.</p><p>{PARAGRAPH}</p></article></body>"
    assert html_extract.blocks_of(page, trees) == ["Head", f"{PARAGRAPH} So a+b holds.", PARAGRAPH]


def test_held_out_pages(trees):
    x, y = html_extract.labelled(60, seed=77)
    assert ((trees.score(x) >= 0.5) == (y > 0)).mean() > 0.95


def test_scores_equal_plain_descent():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    x[::7] = x[0]
    trees = gbt.fit(x, (x[:, 2] + 0.3 * rng.normal(size=300) > 0).astype(float), trees=12, depth=3)
    for row, score in zip(x, trees.score(x)):
        total = trees.base
        for feature, limit, value in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            total += value[node - len(feature)]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12


def plain_statistics(text):
    """The classifier's inputs of one text, word by word."""
    data = (text or "").encode()
    found = re.findall(rb"[^\x20\x09-\x0D]+", data)
    of = lambda some: sum(c in some for c in data)
    marks = b"#$%&*+/<=>@\\^_`{|}~[]!"
    n, c, b = len(found), max(len(found), 1), max(len(data), 1)
    pairs = list(zip(found, found[1:]))
    return {
        "log_bytes": np.log1p(len(data)), "log_words": np.log1p(n), "word_length": sum(map(len, found)) / c, "upper": of(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / b, "digit": of(b"0123456789") / b, "symbol": of(marks) / b,
        "stop": of(b".?") / c, "comma": of(b",;:-'\"()") / c, "line": of(b"\n") / c, "high": sum(x >= 0x80 for x in data) / b, "marked_words": sum(any(x in marks for x in w) for w in found) / c,
        "short_words": sum(len(w) <= 3 for w in found) / c, "long_words": sum(len(w) > 20 for w in found) / c, "same_as_before": sum(x == y for x, y in pairs) / c, "distinct_words": len(set(found)) / c,
        "distinct_pairs": len(set(pairs)) / max(len(pairs), 1), "words_a_line": n / (of(b"\n") + 1), "sentence_length": n / (of(b".?") + 1),
    }


def test_statistics_equal_plain_counts(texts):
    import pyarrow as pa

    from terrastack.llm.textkit import buffer

    more = [*texts, None, "", " \n ", "one", "Ab 12 Ab 12, é#x? " * 30, "x" * 50 + " yes yes\n\nno."]
    got = quality.statistics(*buffer(pa.array(more, pa.string())))
    for text, row in zip(more, got):
        want = plain_statistics(text)
        assert list(want) == quality.NAMES and np.allclose(row, list(want.values()))
