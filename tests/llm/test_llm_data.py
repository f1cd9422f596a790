"""Pages, pieces, neighbours and mixes."""

import math
import random
from bisect import bisect_right

import numpy as np
import pytest

from pageloom.llm import mix, nearest, pieces, scans


def noisy(spark):
    body = "The {} layer keeps every entry of the index manifest and the query planner reads it before the token budget grows."
    rows, n = [], 0
    for f in ("a.md", "b.md"):
        for p in range(6):
            n += 1
            text = f"Course Handbook, teaching copy\n{p + 11}\n# Limits {p}\n" + body.format("cache") + " " + body.format("search") + " Every planner reads the mani-\nfest of the index.\n- cache layer\n- token budget\n| item | count |\n|---|---|\n| planner | 3 |"
            if f == "b.md" and p == 2:
                text = text.replace("every entry", "evcry entry", 1).replace("manifest", "rnanifest", 1)
            if f == "b.md" and p == 3:
                text += "\nthe index mani¬"
            rows.append((n, f, p, p + 1, text, None, None, None, None, None))
    rows += [rows[0], (90, "c.md", 0, None, None, None, None, None, None, None), (91, "d.md", 0, 1, "", None, None, None, None, None), (None, "d.md", 1, 1, "x", None, None, None, None, None)]
    rows.append((92, "e.md", 0, 1, None, ["Result:", "66", "Both pre-", "and post-filtering help —"], None, None, None, None))
    return spark.createDataFrame(rows, "block_id long, source_file string, page_pos int, page_number int, raw_text string, raw_lines array<string>, cleaned_text string, slide_title string, created_at timestamp, loaded_at timestamp")


def test_noise_of_pages(spark):
    df = noisy(spark)
    got = {}
    for r in scans.noise(df).collect():
        got.setdefault(r.block_id, set()).add(r.noise)
    for n in range(1, 13):
        assert {"running_line", "page_number", "hyphen_break"} <= got[n], n
    assert "misread" in got[9] and all("misread" not in got[n] for n in range(1, 13) if n != 9)
    assert not {90, 91, 92} & set(got)
    assert scans.noise(df.limit(0)).count() == 0


def test_repaired_pages(spark):
    got = {r.block_id: r.cleaned_text for r in scans.repair(noisy(spark)).collect()}
    t = got[9]
    assert "Handbook" not in t and "\n13\n" not in t and "# Limits 2" in t and "evcry" not in t and "rnanifest" not in t
    assert "reads the manifest of the index." in t and "| planner | 3 |" in t and "- cache layer" in t
    assert got[90] == "" and got[91] == "" and len(got) == 15


def text_of(n):
    out = []
    while sum(map(len, out)) < n:
        out.append(random.choice(["word", "a", "  ", "\n\n", "\n", ". ", "。", "中文字符", "don’t", "x" * random.choice([3, 50]), "é", "👩‍💻", "! ", " ", " "]))
    return "".join(out)[:n]


def test_pieces_and_ranges_agree():
    random.seed(0)
    for _ in range(120):
        t = text_of(random.randint(1, 2500))
        limit, overlap = random.choice([50, 100, 300]), random.choice([0, 10, 30])
        whole = list(pieces.Cutter(t, limit, overlap).pieces(0))
        assert all(b - a <= limit for a, b in whole) and whole[0][0] == 0 and whole[-1][1] == len(t)
        for (a, b), (c, d) in zip(whole, whole[1:], strict=False):
            assert a < c <= b < d and b - c <= overlap
        size, got, entry = random.choice([limit // 2 + 1, limit + 5, 3 * limit]), [], 0
        for begin in range(0, len(t), size):
            own, left = min(size, len(t) - begin), min(limit, begin)
            part, last = t[begin - left : begin + own + limit + 8], begin + own + limit + 8 >= len(t)
            runs = pieces.range_table(part, left, own, limit, overlap, last)
            if entry >= own:
                entry -= own
                continue
            cutter = pieces.Cutter(part, limit, overlap, len(part) if last else len(part) + limit)
            got += [(a - left + begin, b - left + begin) for a, b in cutter.pieces(left + entry, left + own)]
            entry = runs[bisect_right([r[0] for r in runs], entry) - 1][2]
        assert got == whole


def test_oversized_items_and_files(spark, tmp_path):
    random.seed(1)
    long = text_of(9000)
    df = spark.createDataFrame([("a", long), ("a", long), ("b", "short"), ("c", None), ("d", ""), (None, "z" * 150)], "k string, t string")
    want = pieces.split_text(long, 120, 20)
    for size in (None, 500, 120, 1 << 18):
        got = {}
        for r in pieces.oversized(df, "k", "t", 120, 20, size).collect():
            got.setdefault(r.k, {})[r.chunk_index] = r.content
        assert set(got) == {"a", None} and [got["a"][i] for i in range(len(want))] == want and len(got["a"]) == len(want)
        assert "".join(got[None].values()).count("z") >= 150
    # more ranges than one composed table holds
    giant = text_of(120 * (pieces.RUN + 150))
    got = pieces.oversized(spark.createDataFrame([(1, giant)], "k int, t string"), "k", "t", 120, 20, 120).orderBy("chunk_index").collect()
    assert [r.content for r in got] == pieces.split_text(giant, 120, 20) and [r.chunk_index for r in got] == list(range(len(got)))
    (tmp_path / "f.txt").write_text(long)
    (tmp_path / "e.txt").write_text("")
    files = pieces.split_files(spark, str(tmp_path), 120, 20, 700).orderBy("chunk_index").collect()
    assert [r.content for r in files] == want
    assert pieces.oversized(df.limit(0), "k", "t", 120).count() == 0
    with pytest.raises(ValueError):
        pieces.Cutter("x", 10, 10)


def test_batched_queues_visit_what_the_queue_gives_up():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = nearest.fit(x, 60)
    homes = tree.home(x[:50])
    for most in (1, 7, 25, len(tree.leaves)):
        bound = tree.bounds(x[:50], most)
        for v, b, home in zip(x[:50], bound, homes, strict=True):
            walked = tree.walk(v, most)
            assert walked[0] == home
            # leaves their node held back share its priority: among those of the last one the queue may stop anywhere
            assert {k for k in range(len(b)) if b[k] > b[walked[-1]]} <= set(walked) <= {k for k in range(len(b)) if b[k] >= b[walked[-1]]}


def test_recall_of_isolated_and_close_vectors(spark):
    """One recall is asked of all queries; it holds over all k neighbours, of vectors without near ones too."""
    rng = np.random.default_rng(3)
    lone = rng.normal(size=(2500, 32))
    near = np.repeat(rng.normal(size=(100, 32)), 12, axis=0) + 0.1 * rng.normal(size=(1200, 32))
    x = np.concatenate((lone, near)).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    kth = np.sort(s, axis=1)[:, -10]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<float>")
    got = nearest.nearest(df, "id", "v", k=10, dim=32).toPandas()
    assert len(got) == 10 * len(x)
    good = np.bincount(got.id, s[got.id, got.neighbour] >= kth[got.id] - 1e-5, len(x)) / 10
    assert good.mean() >= 0.93 and good[2500:].mean() >= 0.97 and good[:2500].mean() >= 0.9
    close = nearest.nearest(df, "id", "v", k=10, dim=32, at_least=0.85)
    assert sorted(map(tuple, close.select("id", "neighbour").collect())) == sorted((a, b) for a, b, c in zip(got.id, got.neighbour, got.sim, strict=True) if c >= 0.85)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base[i % 40] + 0.1 * rng.normal(size=8) for i in range(600)]).reshape(-1, 8).astype(np.float32)
    x[50:90] = x[50]  # a class of copies larger than any list
    rows = [(f"k{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [rows[0], ("null", None), ("zero", [0.0] * 8), ("short", [1.0]), ("nan", [float("nan")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    got = {}
    for r in nearest.nearest(df, "id", "v", k=5, dim=8).collect():
        got.setdefault(r.id, []).append((r.neighbour, r.sim))
    assert set(got) == {f"k{i:04d}" for i in range(600)} and all(len(v) == 5 and k not in dict(v) for k, v in got.items())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    kth = np.sort(s, axis=1)[:, -5]
    good = sum(s[int(k[1:]), int(n[1:])] >= kth[int(k[1:])] - 1e-5 for k, v in got.items() for n, _ in v)
    assert good >= 0.9 * 3000
    assert all(sim > 0.9999 for _, sim in got["k0060"])
    assert nearest.nearest(df.limit(0), "id", "v", k=5, dim=8).count() == 0


def test_poisson_counts_match_the_distribution():
    u = (np.arange(20000) + 0.5) / 20000
    n = mix.poisson_count(u, 1.7, 50)
    for k in range(6):
        assert abs((n == k).mean() - math.exp(-1.7) * 1.7**k / math.factorial(k)) < 1e-3
    assert mix.poisson_count(u, 1.7, 2).max() == 2 and (mix.poisson_count(u, math.inf, 3) == 3).all()


def test_counts_by_steps_at_any_cap(spark):
    """A cap of thousands is a list of steps, not a nested expression."""
    docs = spark.createDataFrame([(i, "a", 10) for i in range(20)] + [(100 + i, "b", 1000) for i in range(40)], "doc long, source string, n long")
    t = spark.createDataFrame([("m", "a", 1.0, 3000), ("m", "b", 1.0, 2)], "mix_name string, source string, target_share double, max_repeats int")
    s = {r.source: r for r in mix.shares(mix.mix(docs, t, "doc", "source", "n"), t).collect()}
    assert abs(s["a"].actual_share - 0.5) < 0.02
    u = (np.arange(2000) + 0.5) / 2000
    for rate in (0.3, 4.0, 90.0, math.inf):
        assert (np.searchsorted(mix.steps(rate, 150), u, "right") == mix.poisson_count(u, rate, 150)).all()


def test_mix_reaches_its_shares(spark):
    random.seed(4)
    docs = [(i, "abc"[min(2, int(random.random() * 4))], random.randint(1, 400)) for i in range(6000)]
    docs += [(9001, None, 5), (9002, "other", 5), (9003, "a", None), (9004, "a", 0), (None, "a", 7)]
    d = spark.createDataFrame(docs, "doc long, source string, n long")
    t = spark.createDataFrame([("m", "a", 2.0, 1), ("m", "b", 1.0, 4), ("m", "c", 1.0, 2), ("m", "gone", 1.0, 3)], "mix_name string, source string, target_share double, max_repeats int")
    out = mix.mix(d, t, "doc", "source", "n")
    uses = out.groupBy("doc", "source").count().collect()
    cap = {"a": 1, "b": 4, "c": 2}
    assert all(r["count"] <= cap[r.source] for r in uses)
    s = {r.source: r for r in mix.shares(out, t).collect()}
    assert s["gone"].actual_share == 0 and s["gone"].reachable_share is None
    assert all(abs(s[k].actual_share - s[k].reachable_share) < 0.01 for k in "abc")
    assert sorted(map(str, out.collect())) == sorted(map(str, mix.mix(d, t, "doc", "source", "n").collect()))
    assert mix.mix(d.limit(0), t, "doc", "source", "n").count() == 0 and mix.mix(d, t.limit(0), "doc", "source", "n").count() == 0


def test_other_columns_may_have_any_name(spark):
    """Columns named like those the operators use inside have no effect."""
    from pageloom.llm import encode, garbled, pairs, unify

    inside = "item text h doc vec key form spelling chunk chunk_key pos ids leaf cid source size bucket uses pairs restored answer question pair_key n v".split()
    rows = [(f"k{i}", "Some text of ｗords " * (i + 1), [float(i + 1), 1.0], "b", 3) for i in range(4)] + [("k9", "Some text of words ", [1.0, 2.0], "b", 3)]
    df = spark.createDataFrame(rows, "id0 string, body0 string, vec0 array<double>, src0 string, size0 long")
    for name in inside:
        df = df.withColumn(name, df.size0 * 0)
    assert {r.key_a for r in unify.look_alikes(df, "id0", "body0").collect()} == {"k0"}
    assert encode.token_ids(df, "id0", "body0").count() == 5
    assert garbled.restore(df, "id0", "body0").count() == 5
    assert pairs.defects(df, "id0", "body0", "body0").where("defect = 'copy'").count() == 5
    assert pieces.oversized(df, "id0", "body0", 30, 5).select("id0").distinct().count() == 3
    assert nearest.nearest(df, "id0", "vec0", k=2, dim=2).count() == 10
    t = spark.createDataFrame([("m", "b", 1.0, 2)], "mix_name string, source string, target_share double, max_repeats int")
    assert mix.mix(df, t, "id0", "src0", "size0").count() == 10


def test_blocks_are_not_copied_for_numbers_of_queries():
    import numpy as np

    from pageloom.llm import nearest

    leaves = np.eye(64, dtype=np.float32)
    tree = nearest.Tree(leaves[:1], leaves, np.array([0, 64]), np.zeros(1, np.float32))
    p = nearest.plan(tree, 3, {k: 60_000 for k in range(64)}, 6)
    assert p.blocks == 64 and p.groups == 1  # 3.8 million queries pass by each block
    assert nearest.plan(tree, 3, {0: 100}, 6).groups == 6
