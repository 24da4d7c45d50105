"""The training-data operators against brute force, on small tables with nulls, ties, copies and odd columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamline.llm import chat_collapse, decontamination, license_scan, line_dedup, minhash_dedup, mixing, quality_crf, quartile_digest, url_filters, warc_bundles
from loamline.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls string, rank int"


def frame(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    full = [(i, t, "en", s, len(t or ""), "x", 1) for i, t, s in ((*r, "s") if len(r) == 2 else r for r in rows)]
    return spark.createDataFrame(full, DOCS).repartition(3)


def words_of(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_corpus(seed):
    rng, rows = random.Random(seed), []
    for base in range(6):
        text = words_of(rng, 60)
        for _ in range(7):
            copy = list(text)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(60)] = f"e{rng.randrange(50)}"
            rows.append(" ".join(copy))
    rows += [rows[0], rows[0], "", None, "  ", "one two", "ONE\ttwo", "a b c", "one two three", " ".join(["x"] * 50), "é É 😀 ü " * 20]
    return [(n * 3 % 101, t) for n, t in enumerate(rows)] + [(None, rows[0]), (7, rows[3]), (7, rows[3])]


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize(("seed", "k"), [(1, 4), (2, 5)])
def test_near_duplicates(spark, seed, k):
    rows = near_corpus(seed)
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)].append(i)
    want = sorted(((i, len(s), min(least[root(a)], default=None) if s else i) for a, ((i, _), s) in enumerate(zip(rows, sets))), key=str)
    got = minhash_dedup.near_duplicates(frame(spark, rows), shingle_words=k).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_nothing(spark):
    assert minhash_dedup.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_index_guarantee():
    """Signatures with up to 2 * CHUNKS - 1 differences share a key."""
    rng = np.random.default_rng(3)
    n = minhash_dedup.CHUNKS * minhash_dedup.WIDTH
    for _ in range(200):
        a = rng.integers(0, 1 << 16, n).astype(np.int32)
        b = a.copy()
        at = rng.choice(n, 2 * minhash_dedup.CHUNKS - 1, replace=False)
        b[at] ^= 1
        ka, kb = minhash_dedup._index_keys(np.stack([a, b]))
        assert set(ka.tolist()) & set(kb.tolist())


# line dedup


def brute_lines(rows, least):
    """Every line inside a run of at least ``least`` words that occurs at an earlier place: each pair of places is extended as far as its lines are equal."""
    docs = sorted({(i is None, i, t) for i, t in rows if t is not None}, key=lambda d: (d[0], d[1] or 0, hash_key(d[2])))
    lines = [t.split("\n") for _, _, t in docs]
    places = [(d, a) for d, own in enumerate(lines) for a in range(len(own))]
    dead = [set() for _ in docs]
    for n, (d, a) in enumerate(places):
        for e, b in places[:n]:
            k = 0
            while a + k < len(lines[d]) and b + k < len(lines[e]) and lines[d][a + k] == lines[e][b + k]:
                k += 1
            if sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines[d][a : a + k]) >= least:
                dead[d] |= set(range(a, a + k))
    return {(i, t): "\n".join(x for k, x in enumerate(own) if k not in gone) for (_, i, t), own, gone in zip(docs, lines, dead)}


_KEYS = {}


def hash_key(text):
    return _KEYS[text]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(words_of(rng, rng.choice([0, 1, 2, 3, 5, 8, 12]))) for _ in range(14)]
    rows = [(n, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own {n} {rng.random()}" for _ in range(rng.randrange(1, 14)))) for n in range(30)]
    rows += [(40, rows[3][1]), (41, rows[3][1]), (42, None), (43, ""), (44, "a b\n" * 30), (3, rows[3][1]), (None, rows[5][1])]
    docs = frame(spark, rows)
    _KEYS.update({r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()})
    want = brute_lines(rows, 10)
    got = line_dedup.drop_repeated_runs(docs, min_words=10)
    assert got.columns == [*docs.columns, "_runs"]
    for r in got.collect():
        assert r.text == (None if r.text is None else want[r.doc_id, next(t for i, t in rows if i == r.doc_id)])
        assert r.n_chars == (None if r.text is None else len(r.text)) or r._runs.n_removed == 0
    assert got.count() == len(rows)
    assert line_dedup.drop_repeated_runs(docs.limit(0), min_words=10).count() == 0


def brute_runs(rows, least):
    """Every line inside any run, of whatever length, of at least ``least`` words that occurs at an earlier place."""
    docs = sorted({(i is None, i, t) for i, t in rows if t is not None}, key=lambda d: (d[0], d[1] or 0, hash_key(d[2])))
    out, seen = {}, set()
    for _, i, t in docs:
        lines = t.split("\n")
        n = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        dead = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(n[a:b]) >= least:
                    if tuple(lines[a:b]) in seen:
                        dead |= set(range(a, b))
                    seen.add(tuple(lines[a:b]))
        out[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in dead)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_line_dedup_deletes_whole_runs(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(words_of(rng, rng.choice([0, 0, 1, 2, 3, 5, 8, 12, 40]))) for _ in range(14)]
    rows = [(n, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {n} {rng.random()}" for _ in range(rng.randrange(1, 20)))) for n in range(40)]
    rows += [(n + 50, rows[n][1] + "\nnew") for n in range(12)] + [(70, rows[3][1]), (71, None), (72, ""), (None, rows[5][1]), (3, rows[3][1]), (73, "a b\n" * 30)]
    docs = frame(spark, rows)
    _KEYS.update({r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()})
    for least in (10, 25):
        want = brute_runs(rows, least)
        got = line_dedup.drop_repeated_runs(docs, min_words=least).withColumn("h", F.lit(1)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.text == (None if r.text is None else want[r.doc_id, next(t for i, t in rows if i == r.doc_id)])


def test_line_dedup_keeps_no_tail(spark):
    rng = random.Random(9)
    line = lambda n: " ".join(words_of(rng, n, 10**6))
    planted, long, short = (["\n".join(line(n) for n in sizes) for sizes in ((60, 10), (153, 27, 29, 33, 3), (7, 25, 25, 3, 4))])
    rows = [(n, t) for n, t in enumerate([planted, long, short] * 2)] + [(6, f"own line\n{planted}\nlast line")]
    got = {r.doc_id: (r.text, r._runs.n_removed) for r in line_dedup.drop_repeated_runs(frame(spark, rows)).collect()}
    assert got == {0: (planted, 0), 1: (long, 0), 2: (short, 0), 3: ("", 2), 4: ("", 5), 5: ("", 5), 6: ("own line\nlast line", 2)}


# decontamination


def test_contamination(spark):
    rng = random.Random(5)
    items = [(n, " ".join(words_of(rng, rng.choice([3, 9, 10, 14, 25])))) for n in range(12)] + [(20, None), (21, ""), (None, "w1 w2 w3 w4"), (22, "the"), (0, "w7 w8 w9")]
    rows = []
    for n in range(40):
        w = words_of(rng, rng.randrange(0, 60))
        if n % 3 == 0:
            w[5:5] = items[n % 12][1].upper().split()[: rng.randrange(1, 30)]
        rows.append((n, " , ".join(w)))
    rows += [(50, None), (51, ""), (52, "the The thé"), (53, items[2][1] + "\n" + items[2][1]), (1, rows[3][1]), (3, rows[3][1]), (None, items[4][1])]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            q = split(text)
            k = min(10, len(q))
            for a in range(len(q) - k + 1 if q else 0):
                for s in range(len(w) - k + 1):
                    if w[s : s + k] == q[a : a + k]:
                        hit |= set(range(s, s + k))
                        found |= {str(item)} if item is not None else set()
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, pos int")
    got = decontamination.contamination(frame(spark, rows), bench).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert decontamination.contamination(frame(spark, rows), bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.contamination(frame(spark, rows).limit(0), bench).count() == 0


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "rare1 a b c d e f g h rare2")], "item_id long, text string")
    docs = frame(spark, [(1, "x rare1 a b c d e f g h rare2"), (2, "rare1 a b c d e f g h i j rare2"), (3, "rare2 rare1"), (4, "a b c d e f g h " * 9)])
    got = {r.doc_id: r["shift"] for r in decontamination.proximity(docs, bench, slack=3).collect()}
    assert got == {1: 0, 2: 2}


def near_windows(rows, items, missing, slack, window=10):
    """{(doc place, window): least summed shift at the start with most words} by trying every start."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = set()
    for _, text in items:
        q = split(text)
        wins |= {tuple(q[a : a + window]) for a in range(max(1, len(q) - window + 1)) if q}
    out = {}
    for n, (_, t) in enumerate(rows):
        w = split(t)
        for q in wins:
            for s in range(-window - slack, len(w) + slack):
                offs = []
                for i, term in enumerate(q):
                    at = [abs(d) for d in range(-slack, slack + 1) if 0 <= s + i + d < len(w) and w[s + i + d] == term]
                    offs += [min(at)] if at else []
                if len(offs) >= len(q) - max(0, min(missing, len(q) - 2)):
                    out[n, q] = min(out.get((n, q), (0, 10**6)), (-len(offs), sum(offs)))
    return out


@pytest.mark.parametrize(("missing", "slack"), [(1, 3), (2, 2), (0, 1)])
def test_proximity_by_brute_force(spark, missing, slack):
    rng = random.Random(missing + 7)
    items = [(n, " ".join(words_of(rng, rng.choice([1, 2, 3, 9, 10, 14, 25]), 60))) for n in range(10)] + [(20, None), (21, "w1 w1 w1 w2 w2 w3 w1 w1 w2 w9"), (22, "zebra w1 w2 w3 w4 w5 w6 w7 w8 quokka")]
    rows = []
    for n in range(60):
        w = words_of(rng, rng.randrange(0, 40), 60)
        part = items[n % 10][1].split()[rng.randrange(2) :]
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(part) or 1)
            part[k : k + rng.randrange(2)] = rng.choice([["new"], ["W5", "other"], []])
        rows.append((n, " ".join(w[:9] + part + w[9:])))
    rows += [(80, None), (81, ""), (82, "w1 " * 40), (83, "zebra x x x x x x x x quokka"), (84, "zebra w1 w2 w3 w4 none w6 w7 w8 quokka"), (85, "w1 w2 w3 w4 w5 w6 w7 w8 quokka"), (3, rows[4][1]), (3, rows[4][1])]
    # a passage that starts at no multiple of ten, with a word replaced
    q = [f"k{i}" for i in range(30)]
    items.append((23, " ".join(q)))
    rows.insert(0, (90, " ".join([*q[4:9], "other", *q[10:14]])))
    want = near_windows(rows, items, missing, slack)
    assert (0, tuple(q[4:14])) in want or missing == 0
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(frame(spark, rows), bench, near=(missing, slack)).collect()
    counts = Counter(n for n, _ in want)
    assert len(want) > 15 and sorted(((r.doc_id, r.n_near) for r in got), key=str) == sorted(((rows[n][0], counts[n]) for n in range(len(rows))), key=str)
    listed = decontamination.proximity(frame(spark, rows[:-2]), bench, slack=slack, missing=missing).collect()
    assert sorted((r.doc_id, r["shift"]) for r in listed) == sorted((rows[n][0], v[1]) for (n, _), v in want.items() if n < len(rows) - 2)


def test_texts_without_candidates_stay_where_they_are(spark, monkeypatch):
    rng = random.Random(41)
    rows = [(n, " ".join(rng.randbytes(6).hex() for _ in range(200))) for n in range(400)]
    # copies under other ids, and rows that repeat
    rows += [(400, rows[7][1]), (7, rows[7][1]), (None, rows[7][1])]
    bench = spark.createDataFrame([(1, " ".join(rows[7][1].split()[50:64]))], "item_id long, text string")

    def shuffled():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    moved, write = {}, decontamination.staged

    def staged(df, name):
        before = shuffled()
        out = write(df, name)
        moved[name] = shuffled() - before
        return out

    monkeypatch.setattr(decontamination, "staged", staged)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # as among many documents: what has candidates is above the threshold
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench, near=(1, 3)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted((r.doc_id for r in got if r.contaminated), key=str) == [400, 7, 7, None]
    assert {(r.n_hit, r.n_near) for r in got if r.contaminated} == {(14, 5)} and len(got) == len(rows)
    assert 0 < moved["candidates"] < sum(len(t) for _, t in rows) / 8


def test_filter_of_texts_keeps_every_key(spark):
    texts = frame(spark, [(n, f"text {n}") for n in range(3000)] + [(3000, None), (3001, "text 4"), (3002, "")]).withColumn("text_key", F.xxhash64("text"))
    keys = texts.filter("doc_id % 10 = 4 or text is null").select(F.col("text_key").alias("t")).distinct()
    got = decontamination._likely(texts, keys)
    assert got.columns == texts.columns
    ids = [r.doc_id for r in got.collect()]
    want = {n for n in range(3000) if n % 10 == 4} | {3000, 3001}
    assert want <= set(ids) and len(ids) < len(want) + 5
    assert decontamination._likely(texts, keys.limit(0)).count() == 0


# mixing


def waterfill(sizes, weights, cap):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest, open_ = total - sum(fixed.values()), [s for s in names if s not in fixed]
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = [(n, " ".join(words_of(rng, rng.randrange(0, 30))), rng.choice(["a", "b", "b", "b", "B", "é", None, "tiny"] if n > 5 else ["tiny"])) for n in range(300)]
    rows += [(900, None, "a"), (901, "", "empty"), (3, "x y", "a"), (3, "x y", "a"), (None, "x", "b")]
    docs = frame(spark, rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = waterfill(sizes, (5, 2, 1), 3)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by_target = defaultdict(int)
    for r in got:
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        by_target[r.source_size, round(r.target, 6)] += r.taken
    assert {k[1] for k in by_target} == {round(v, 6) for v in want.values()}
    for (_, target), taken in by_target.items():
        assert abs(taken - target) <= 30
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(docs.limit(0)).count() == 0


# urls


def test_url_rules(spark):
    urls = ["http://a.org/x", "HTTP://A.ORG/x", "http://example.org/es/1", "http://m.example.org/en/12?x#y", "https://x.com/fr/a", "https://x.com/de/a", "http://a.org", "http://notorg/x", "http://x.net/de/1", "no url", "", None, "http://a.org:80/x", "a://b.org/c://d"]
    rows = [(n, u, "h") for n, u in enumerate(urls)] + [(0, urls[0], "h"), (None, urls[5], "h")]
    got = url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        url = urls[r.page_id] if r.page_id is not None else urls[5]
        m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[2]), m[3]) if m else ("", "")
        fits = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule[0])
        assert r.verdict in ("allow", "block") and (rule[1] is None or r.verdict == rule[1])
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def test_templates_learn_from_rules(spark):
    rows = [(n, f"http://x.net/{'spam' if n % 2 else 'news'}/{n}") for n in range(200)] + [(1000 + n, f"http://x.net/{'spam' if n % 2 else 'news'}/{n}/more") for n in range(20)]
    rules = [("x.net", f"/spam/{n}", "block") for n in range(1, 9)] + [("x.net", "/news/", "allow")]
    got = url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).filter("rule is null").collect()
    assert {r.verdict for r in got} == {"block"} and all(r.template.startswith("/spam") for r in got)


def brute_templates(urls, z=2.58, least=5.0):
    """{segs: template} of one tree, urls {segs: (blocked, labelled)}; node by node in Python."""
    out, nodes, level = {}, {"": list(urls)}, 0
    while nodes:
        following = defaultdict(list)
        for node, paths in nodes.items():
            b, n = (sum(urls[p][k] for p in paths) for k in (0, 1))
            if min(b, n - b) < 2 * least or all(len(p) <= level for p in paths):
                out |= {p: node + "/**" for p in paths}
                continue
            child = defaultdict(lambda: [0, 0])
            for p in paths:
                if len(p) > level:
                    child[p[level]][0] += urls[p][0]
                    child[p[level]][1] += urls[p][1]
            branch, moved = {s: "" for s, c in child.items() if c[1]}, True
            while moved:
                totals, new = defaultdict(lambda: [0, 0]), {}
                for s, k in branch.items():
                    totals[k][0] += child[s][0]
                    totals[k][1] += child[s][1]
                for s, k in branch.items():
                    (cb, cn), (pb, pn) = child[s], totals[k]
                    rest = pn - cn
                    if rest and min(cn, rest) * min(pb, pn - pb) >= least * pn:
                        gap = cb / cn - (pb - cb) / rest
                        error = math.sqrt(pb / pn * (1 - pb / pn) * (1 / cn + 1 / rest))
                        if abs(gap) > z * error:
                            new[s] = k + ("+" if gap > 0 else "-")
                moved, branch = bool(new), branch | new
            shared = Counter(branch.values())
            for p in paths:
                if len(p) <= level:
                    out[p] = node or "/"
                else:
                    k = branch.get(p[level], "")
                    following[node + "/" + ("*" if not k else p[level] if shared[k] == 1 else "*" + k)].append(p)
        nodes, level = following, level + 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_by_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["spam", "ads", "news", "blog", "*", "shop"]
    urls = []
    for _ in range(1500):
        host = rng.choice(["a.net", "b.net", "c.net"])
        segs = ["x"] * rng.randrange(2) + rng.choices(words, k=rng.randrange(3)) + [str(rng.randrange(40))] * rng.randrange(2)
        urls.append(f"http://{host}/" + "/".join(segs))
    rules = [("a.net", "/spam", "block"), ("a.net", "/ads", "block"), ("a.net", "/x/shop", "block"), ("a.net", "/", "allow"), ("b.net", "/x/*", "block"), ("b.net", "/x/spam", "block"), ("b.net", "/x", "allow")]
    got = url_filters.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    counts = {h: defaultdict(lambda: [0, 0]) for h in ("a.net", "b.net", "c.net", "all")}
    parsed = []
    for u in urls:
        host, _, path = u[7:].partition("/")
        segs = tuple(s.replace("*", "%2A") for s in path.split("/") if s)
        fits = [(h + p, v) for h, p, v in rules if host == h and ("/" + path).startswith(p)]
        verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))[1]
        for tree in (host, "all"):
            counts[tree][segs][0] += verdict == "block"
            counts[tree][segs][1] += verdict is not None
        parsed.append((host, segs, verdict))
    trees = {tree: brute_templates(c) for tree, c in counts.items()}
    sums = {tree: defaultdict(lambda: [0, 0]) for tree in trees}
    for tree, named in trees.items():
        for segs, template in named.items():
            for k in (0, 1):
                sums[tree][template][k] += counts[tree][segs][k]
    overall = sum(c[0] for c in counts["all"].values()) / sum(c[1] for c in counts["all"].values())
    assert len(set(trees["a.net"].values())) > 4 and any("*+" in x or "*-" in x for x in {*trees["a.net"].values(), *trees["all"].values()})
    for r in got:
        host, segs, verdict = parsed[r.page_id]
        b, n = sums["all"][trees["all"][segs]]
        wide = (b + 8 * overall) / (n + 8)
        b, n = sums[host][trees[host][segs]]
        assert r.template == trees[host][segs] and math.isclose(r.score, (b + 8 * wide) / (n + 8))
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def test_deep_paths_and_ties(spark):
    deep = [(n, f"http://x.net/a/b/c/d/{'spam' if n % 2 else 'news'}/{n}") for n in range(200)] + [(1000 + n, f"http://y.net/a/b/c/d/{'spam' if n % 2 else 'news'}/{n}") for n in range(10)]
    long = [(2000, "http://x.net/" + "s/" * 20_000), (2000, "http://x.net/" + "s/" * 20_000)]
    rules = [("x.net", "/a/b/c/d/spam", "block"), ("x.net", "/a/b/c/d/news", "allow")]
    rows = url_filters.judge_urls(spark.createDataFrame(deep + long, "page_id long, url string"), rules).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == 212 and all(got[1000 + n].verdict == ("block" if n % 2 else "allow") for n in range(10))
    tie = url_filters.judge_urls(spark.createDataFrame([(1, "http://t.net/b"), (2, "http://t.net/a"), (3, "http://t.net/c")], "page_id long, url string"), [("t.net", "/b", "block"), ("t.net", "/a", "allow")])
    assert {r.page_id: (r.verdict, r.score) for r in tie.collect()}[3] == ("block", 0.5)


# conversations


def test_chat_collapse(spark):
    talks = {1: ["a"], 2: ["a", "b"], 3: ["a", "b", "c"], 4: ["a", "x"], 5: ["a", "b", "c"], 6: ["b"], 7: [None, "z"], 8: [None], 9: ["a", "b", "c", "d"], 10: ["q"] * 5, 11: ["q"] * 3}
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", t, 1) for c, ts in talks.items() for k, t in enumerate(ts)] + [(None, 0, "user", "own", 1), (12, None, None, "", 1)]
    got = chat_collapse.maximal_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, h int").repartition(4)).collect()
    kept = {r.conv_id for r in got}
    assert kept == {4, 6, 7, 9, 10, None, 12}
    chats = {r.conv_id: r for r in got}
    assert chats[4].chat == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n" and chats[4].n_turns == 2
    assert chats[7].chat.startswith("<|im_start|>user\n<|im_end|>")
    copies = chat_collapse.maximal_chats(spark.createDataFrame([(c, 0, "user", "t") for c in (5, 3, 9)], "conv_id long, turn long, role string, text string")).collect()
    assert [(r.conv_id, r.n_copies) for r in copies] == [(3, 3)]
    assert chat_collapse.maximal_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# archives


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 200
    rows = [(5, "http://a/5", big), (3, "http://a/3", big), (9, None, big), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (3, "again", big), (None, "n", big), (10, "u\r\nX", "y" * 3_000_000), (11, "u", "\r\n\r\nWARC/1.1")]
    got = warc_bundles.archive_round_trip(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")).collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        firsts = [j for j, _, x in rows if (x or "") == (h or "") and j is not None]
        other = len(data) >= 100 and firsts and i != min(firsts)
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if other else "response", min(firsts) if other else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc_bundles.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_bundles_are_seekable(spark, tmp_path):
    import zstandard

    pages = spark.createDataFrame([(n, f"http://a/{n}", str(n) * 50_000) for n in range(60)], "page_id long, url string, html string").coalesce(1)
    index = warc_bundles.write_bundles(pages, f"file://{tmp_path}").collect()
    (name,) = {r.bundle for r in index}
    data = (tmp_path / name).read_bytes()
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read().count(b"WARC/1.1\r\n") == 60
    assert len({r.frame for r in index}) > 1
    assert warc_bundles.read_bundles(spark.createDataFrame(index).filter("record_key = '42'"), f"file://{tmp_path}").first().payload_bytes == 100_000


def test_revisits_name_records_that_hold_the_payload(spark, tmp_path):
    big, other = "x" * 500, "y" * 500
    rows = [(1, "u", big), (1, "v", big), (1, "w", other), (2, "u", big), (3, None, big), (4, "u", other), (None, "u", other)]
    folder = f"file://{tmp_path}"
    index = warc_bundles.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    assert index.select("record_id").distinct().count() == len(rows)
    records = warc_bundles.read_bundles(index, folder)
    out = warc_bundles.resolved(records).collect()
    held = {r.record_id: r for r in out if r.record_type == "response"}
    assert len(held) == 3 and sum(r.refers_to == "1" for r in out) == 4
    for r in out:
        if r.record_type == "revisit":
            assert held[r.refers_to_id].payload_digest == r.payload_digest and held[r.refers_to_id].payload_bytes == r.payload_bytes
    with pytest.raises(Exception, match="no such payload"):
        warc_bundles.resolved(spark.createDataFrame([r for r in records.collect() if r.record_type == "revisit"], records.schema)).collect()
    wrong = spark.createDataFrame([(*r[:-1], 0) for r in index.collect()], index.schema)
    with pytest.raises(Exception, match="names another record"):
        warc_bundles.read_bundles(wrong, folder).collect()


# fingerprints


def test_fingerprints(spark):
    rng = random.Random(2)
    rows = [(n, " ".join(words_of(rng, rng.randrange(50, 200), 5000))) for n in range(60)] + [(70, None), (71, ""), (72, "é😀"), (73, "a" * 300_000), (5, rows5 := "five again"), (None, "none"), (80, rows5)]
    got = quartile_digest.fingerprints(frame(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = {}
    for k, (i, t) in enumerate(order):
        text, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + nxt[:half]
        a, b, c = (quartile_digest.digest(x) for x in (text, new, nxt))
        want[i, len(text)] = (hashlib.sha256(new.encode()).hexdigest(), quartile_digest.encode(a), quartile_digest.encode(b), quartile_digest.likeness(a, b), quartile_digest.likeness(a, c))
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:] == want[r.doc_id, r.n_chars]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    plain = [r for r in got if r.doc_id is not None and r.doc_id < 60 and r.n_chars > 300]
    assert np.mean([r.near_edited > r.near_next for r in plain]) > 0.95
    d = quartile_digest.digest("some text of a kind")
    assert (quartile_digest.decode(quartile_digest.encode(d)) == d).all() and quartile_digest.likeness(d, d) == 1
    assert quartile_digest.fingerprints(frame(spark, rows).limit(0)).count() == 0
    assert quartile_digest.fingerprints(frame(spark, [(1, "only one text")])).first().near_next == 1


# quality


def quality_rows(n=300):
    rng, rows, labels = random.Random(4), [], []
    for i in range(n):
        bad = i % 4 == 0
        lines = [" ".join((w + "!!" if bad else w) for w in words_of(rng, 12)) for _ in range(rng.randrange(1, 8))]
        rows.append((i, "\n".join(lines)))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_quality(spark):
    rows, labels = quality_rows()
    docs, lab = frame(spark, [*rows, (900, None), (901, ""), (None, "x"), (1, "x y " * 50_000)]), spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality_crf.train(docs, lab)
    got = quality_crf.score_documents(docs, model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.doc_id is not None and r.doc_id in truth and r.held_out and r.doc_id != 1]
    assert held and all(r.held_out == quality_crf.crc_held_out(r.doc_id) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert quality_crf.score_documents(docs.limit(0), model).count() == 0
    flipped = spark.createDataFrame([(i, 1 - q if quality_crf.crc_held_out(i) else q, 0) for i, q, _ in labels], "doc_id long, quality int, toxic int")
    same = quality_crf.train(docs, flipped)  # held-out labels are never seen
    plain = quality_crf.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert np.allclose(same.weights, plain.weights)
    none = quality_crf.train(docs, lab.limit(0))
    assert none.score("anything") == 0.5


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    emit, trans = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    total, good = 0.0, np.zeros(5)
    for code in range(32):
        y = [code >> k & 1 for k in range(5)]
        p = np.exp(sum(e for e, k in zip(emit[0], y) if k) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total, good = total + p, good + p * np.array(y)
    assert np.allclose(quality_crf._chain(emit, trans)[0][0], good / total)
    x = np.zeros((5, quality_crf.FEATURES))
    x[:, 0] = emit[0]
    crf = quality_crf.LineCrf(np.zeros(quality_crf.FEATURES), np.ones(quality_crf.FEATURES), np.eye(quality_crf.FEATURES)[0], trans)
    assert np.allclose(crf.marginals(x), good / total)


# licences


def test_licences(spark):
    rng = random.Random(6)
    plain = [" ".join(words_of(rng, 15)) for _ in range(200)]
    model = license_scan.fit(plain)
    notices = [(f, t) for f, ts in license_scan.TEMPLATES.items() for t in ts]
    rows = [(n, f"{plain[n]}\n{t}\n{plain[n + 1]}") for n, (_, t) in enumerate(notices)] + [(100, "\n".join(plain)), (101, None), (102, ""), (103, "The driver lost his license after the accident."), (None, "Released under the MIT License.")]
    got = license_scan.scan(frame(spark, rows), model).collect()
    found = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 100}
    assert np.mean([n in found and found[n].family == f and found[n].paragraph == 1 and found[n].confirmed for n, (f, _) in enumerate(notices)]) >= 0.95
    assert not [r for r in got if r.doc_id is not None and r.doc_id >= 100] and [r.family for r in got if r.doc_id is None] == ["mit"]
    assert license_scan.scan(frame(spark, rows).limit(0), model).count() == 0
    held = [v for f, t in notices[:3] for v in license_scan._variants(np.random.default_rng(99), t, 20)]
    assert np.mean([model.families[model.probabilities(v)[1][0].argmax()] == f for v, f in zip(held, [f for f, _ in notices[:3] for _ in range(20)])]) > 0.9


#: Notices that the model was not trained on: the family, whether it is confirmed.
NEIGHBOURS = {
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": ("agpl", False),
    "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License. To view a copy of this license, visit the site.": ("cc-by-nd", True),
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.": ("cc-by-nc-sa", True),
    "Licensed under the Apache License, Version 1.1": ("other", False),
    "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.": ("artistic", True),
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2.": ("gpl", True),
    "This library is free software; you can redistribute it under the GNU Lesser General Public License version 3.": ("lgpl", True),
    "This database is made available under the Open Database License.": ("other", False),
    "Licensed under either of the Apache License, Version 2.0 or the MIT license at your option.": ("apache-2.0", False),
    "// SPDX-License-Identifier: GPL-2.0-only": ("gpl", True),
}


def test_neighbouring_licences(spark):
    rng = random.Random(37)
    plain = [" ".join(words_of(rng, 12, 3000)) for _ in range(400)]
    model = license_scan.fit(plain)
    rows = [(n, f"{plain[n]}\n\n{t}\n\n{plain[n + 1]}") for n, t in enumerate(NEIGHBOURS)]
    got = {r.doc_id: (r.family, r.confirmed) for r in license_scan.scan(frame(spark, rows), model).filter("paragraph = 2").collect()}
    assert got == dict(enumerate(NEIGHBOURS.values()))
    # clashing columns go; repeated rows give theirs each
    twice = frame(spark, [rows[1], rows[1]]).withColumn("family", F.lit("x")).withColumn("line", F.lit(1))
    assert [r.family for r in license_scan.scan(twice, model).filter("confirmed").collect()] == ["cc-by-nd"] * 2


def test_licence_sums_in_parts(monkeypatch):
    rng = random.Random(39)
    model = license_scan.fit([" ".join(words_of(rng, 12, 300)) for _ in range(50)], variants=2, epochs=1)
    lines = [" ".join(rng.choice(["a", "a", "b.", "..c", "é-d", "x" * 90, "1.5"]) for _ in range(rng.choice([0, 1, 3, 80]))) for _ in range(200)]
    data = b"".join(map(license_scan._encoded, lines))
    whole, n = model.sums(data, len(lines))
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(license_scan, "PART", size)
        sums, m = model.sums(data, len(lines))
        assert (n == m).all() and np.allclose(whole, sums, atol=1e-4)


#: Sentences with words of licences that the model was not trained on.
UNSEEN = ["Her driving licence expired in March and the office was closed.", "The museum keeps a copy of the charter granted to the town.", "Redistribution of land was permitted under the old law.", "The software company moved its office to the harbour.", "He was free to use the garden without any restriction.", "The Mozilla office gave a public talk about version control."]


def test_licence_paragraphs_against_template_containment(spark):
    rng = random.Random(11)
    plain = [" ".join(words_of(rng, 14, 3000)) for _ in range(300)]
    model = license_scan.fit(plain)
    known = [(f, t) for f in license_scan.TEMPLATES for t in [*license_scan.TEMPLATES[f], *license_scan.NOTICES.get(f, ())] if len(t.split()) > 8]

    def wrapped(text, width):
        w = text.split()
        return "\n".join(" ".join(w[i : i + width]) for i in range(0, len(w), width))

    rows, planted = [], {}
    for n in range(120):
        parts = [wrapped(plain[rng.randrange(300)] + " " + plain[rng.randrange(300)], 9) for _ in range(rng.randrange(1, 4))]
        if n % 2:
            f, t = known[n // 2 % len(known)]
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = [wrapped(t, rng.choice([7, 11, 200]))]
            planted[n] = f, "\n\n".join(parts[:at]).count("\n") + (2 if at else 0)
        elif n % 4 == 0:
            parts.append(UNSEEN[n // 4 % len(UNSEEN)])
        rows.append((n, "\n\n".join(parts)))
    rows += [(200, rows[1][1]), (201, rows[1][1]), (202, wrapped(plain[0] * 20_000, 50) + "\n\n" + known[0][1])]
    got = license_scan.scan(frame(spark, rows), model).collect()
    # every paragraph whose word bigrams a template of a family contains, by trying all
    bigrams = lambda x: set(zip(w := re.findall(r"[^\W_]+(?:\.[0-9]+)*", x.lower()), w[1:]))
    want = set()
    for i, t in rows:
        at = 0
        for part in t.split("\n\n"):
            own = bigrams(part)
            if any(len(own & bigrams(x)) >= 0.6 * min(len(own), len(bigrams(x))) for _, x in known):
                want.add((i, at))
            at += part.count("\n") + 2
    confirmed = {(r.doc_id, r.paragraph) for r in got if r.confirmed}
    assert len(confirmed & want) >= 0.97 * len(want) and len(confirmed - want) <= 0.02 * len(want)
    by_place = {(r.doc_id, r.paragraph): r for r in got}
    assert sum((n, at) in by_place and by_place[n, at].family == f for n, (f, at) in planted.items()) >= 0.95 * len(planted)
    assert not [r for r in got if r.doc_id < 200 and r.doc_id not in planted and r.confirmed]
    assert len({r.doc_id for r in got if r.doc_id < 200 and r.doc_id not in planted}) <= 2
    assert {r.doc_id for r in got if r.doc_id >= 200} == {200, 201, 202}
    other = license_scan.scan(frame(spark, [(1, "Licensed under the Quorvax License."), (2, "This work is released under the terms of the Brindle Public License.")]), model).collect()
    assert [(r.family, r.confirmed) for r in other] == [("other", False)] * 2


# pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    rows, labels = quality_rows(200)
    good = " ".join(words_of(rng, 80, 5000))
    passage = " ".join(words_of(rng, 60, 5000))
    item = " ".join(words_of(rng, 15, 5000))
    near = good.split()
    near[3] = "changed"
    rows += [(500, good), (501, " ".join(near)), (502, good), (503, f"first own line here\n{passage}"), (504, f"second own line there\n{passage}"), (505, " ".join(words_of(rng, 40, 5000)) + " " + item), (506, " ".join(words_of(rng, 40, 5000)))]
    frame(spark, rows).drop("cls", "rank").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert out.columns == docs.columns
        seen[name] = {r.doc_id: r for r in out.collect()}
        docs = spark.createDataFrame(list(seen[name].values()), out.schema)
    bad = {i for i, q, _ in labels if q == 0}
    assert not bad & set(seen["quality"]) and {500, 503, 504, 505, 506} <= set(seen["quality"])
    assert 502 not in seen["line_dedup"] and seen["line_dedup"][504].text == "second own line there" and seen["line_dedup"][503].text.endswith(passage)
    assert 500 in seen["near_dedup"] and 501 not in seen["near_dedup"]
    assert 505 not in seen["decontamination"] and 506 in seen["decontamination"]
    assert set(seen["mixing"]) <= set(seen["decontamination"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["mixing"])


def test_pipeline_judges_rows_and_not_ids(spark, tmp_path):
    rng = random.Random(12)
    text = lambda: " ".join(words_of(rng, 60, 5000))
    a, b, c, d, e, f = (text() for _ in range(6))
    item = " ".join(words_of(rng, 15, 5000))
    near = a.replace(a.split()[30], "changed", 1)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    groups = [(3, a), (5, near), (5, b), (None, a), (None, c), (None, c), (None, d), (9, e), (9, e), (9, e + " more"), (None, None), (None, ""), (11, "")]
    got = corpus_pipeline.near_duplicates(spark, frame(spark, [*groups, (9, e, "other")]), str(tmp_path))
    assert got.columns == frame(spark, []).columns
    rows = [(r.doc_id, r.text) for r in got.collect()]
    of_e = [r for r in rows if r[1] in (e, e + " more")]
    assert len(of_e) == 1 and of_e[0][0] == 9
    assert sorted((r for r in rows if r not in of_e), key=str) == sorted([(3, a), (5, b), (None, c), (None, d), (None, None), (None, ""), (11, "")], key=str)

    dirty = [(None, f"{d} {item}"), (None, e), (None, None), (7, f"{item} {f}"), (7, f), (7, f), (8, item)]
    got = corpus_pipeline.decontaminated(spark, frame(spark, dirty), str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(None, e), (None, None), (7, f), (7, f)], key=str)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeats, columns that clash with names used inside, empty tables."""
    rng = random.Random(21)
    text = lambda n=60: " ".join(words_of(rng, n, 5000))
    a, long = text(), "\n".join(text(12) for _ in range(6000))
    schema = "doc_id long, text string, lang string, source string, n_chars long, _runs string, _id long, score double, bytes long, salt int, `a.b` string, size int, row string"
    rows = [(i, t, None, s, len(t or ""), "r", 1, 0.5, 2, 3, "d", 4, "w") for i, t, s in [(1, a, "s"), (1, a, "s"), (2, a, None), (None, a, "s"), (3, None, "s"), (3, None, "s"), (4, "", None), (5, "  ", "s"), (6, long, "t"), (7, text(), "t"), (7, text(), "t"), (None, None, None)]]
    spark.createDataFrame([(7, 1, None), (1, 1, 0), (None, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, ""), (2, text(15))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            before, kept = kept, stage(spark, kept, str(tmp_path))
            if name != "mixing":
                assert kept.columns == docs.columns
            kept = spark.createDataFrame(kept.collect(), kept.schema)
            if name == "line_dedup" and data:
                found = kept.collect()
                assert sorted(r.doc_id for r in found if r.text == a) == [1, 1] and sum(r.text == long for r in found) == 1
                assert sum(r.text is None for r in found) == 3 and sum(r.text == "" for r in found) == 1
            if name == "near_dedup" and data:
                found = kept.collect()
                assert sum(r.text == a for r in found) == 1 and sum(r.text is None for r in found) == 3 and sum(r.doc_id == 7 for r in found) == 2
            if name == "decontamination":
                assert kept.count() == before.count()
        if data:
            taken = kept.collect()
            assert {r.doc_id for r in taken} <= {1, 5, 6, 7} and all(r.taken > 0 for r in taken)
        else:
            assert kept.count() == 0


def test_report_takes_the_place_of_a_column(spark):
    docs = spark.createDataFrame([(1, "a", "mine")], "doc_id long, text string, _runs string")
    out = line_dedup.drop_repeated_runs(docs)
    assert out.columns == ["doc_id", "text", "_runs"] and out.first()._runs.n_lines == 1
    other = line_dedup.drop_repeated_runs(docs, report="told")
    assert other.first()._runs == "mine" and other.first().told.n_removed == 0


def test_long_texts(spark):
    rng = random.Random(31)
    base = words_of(rng, 120_000, 50_000)
    near = [*base]
    for k in range(0, 120_000, 200):
        near[k] = "changed"
    docs = frame(spark, [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(words_of(rng, 120_000, 50_000))), (4, "x" * 3_000_000), (5, "y\n" * 300_000)])
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, shingle_words=4).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    data = (" ".join(base) + " " + "z" * 2_500_000 + " end").encode()
    assert (minhash_dedup.word_hashes(data) == minhash_dedup._word_hashes(data)).all()
    model = quality_crf.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in quality_crf.score_documents(docs, model).collect())
    item = " ".join(base[70_000:70_012])
    hits = {r.doc_id: r.contaminated for r in decontamination.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert hits == {1: True, 2: "changed" not in near[70_000:70_010] or "changed" not in near[70_002:70_012], 3: False, 4: False, 5: False}
    assert mixing.mix(docs).agg(F.sum("size")).first()[0] == 3 * 120_000 + 1 + 300_000
