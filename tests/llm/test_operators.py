"""Corpus operators against brute force, on a small table with nulls, empty, long and repeated texts and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import bpe, decontam, html, neardup, packing, pii, quality, substring, tokencount, urls
from quillgrid.llm.queries import URL_RULES, tokenizer_file

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACE = r"[^\x20\x09-\x0D]+"


def thue_morse(n, letters="ab"):
    """A word of 2**n letters and its complement: polynomials modulo 2**64 give both one hash."""
    a, b = letters
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def texts():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 220))) for _ in range(60)]
    near = []
    for t in base[:25]:
        w = t.split()
        for _ in range(3):
            x = list(w)
            for _ in range(max(1, len(x) // 40)):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            near.append(" ".join(x))
    passage = base[30] + " " + base[31] + " " + base[32]
    mixed = [f"{base[40 + i]} {passage} {base[50 + i % 9]}" for i in range(8)]
    odd = [None, "", " ", "One", "one", "a\x00b \x0b\x0c c", "x" * 20_000, "The the THE", "mail a@b.cd card 4111 1111 1111 1111 ip 10.0.0.1 tel +1 (234) 555-7713", "<|endoftext|> don't \n\n  'll"]
    twins = [x.format(w) for n in (10, 11, 12) for w in thue_morse(n) for x in ("{}", "one two {} three four", f"{base[33]} {{}} {base[34]}")]
    return base + near + mixed + odd + base[:3] + twins


@pytest.fixture(scope="module")
def rows():
    return [(i, t) for i, t in enumerate(texts())] + [(None, "no id here"), (3, texts()[3])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, "en", "word", 1, 2, "x") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, words string, n long, n_words long, component_id string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_near_duplicates(docs, rows):
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = re.findall(SPACE, (t or "").translate(LOWER))
        s = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        if i is not None:
            sets[i].append(s)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, some in sets.items() for s in some if s]
    for a, s in flat:
        for b, r in flat:
            if a < b and 100 * len(s & r) >= 75 * len(s | r):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = neardup.group(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == find(r.doc_id) and r.kept == (r.doc_id == find(r.doc_id))
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    kept = [r.doc_id for r in neardup.keep_one(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({find(i) for i in sets}) and kept.count(None) == 1


def test_banding_misses_no_short_pairs_at_the_limit():
    n = 100_000
    key = np.sort(np.random.default_rng(7).integers(0, 1 << 63, size=(n, 4), dtype=np.uint64), axis=1)
    a = neardup.band_keys(neardup.superminhash(key.ravel(), np.arange(n + 1) * 4))
    b = neardup.band_keys(neardup.superminhash(key[:, :3].ravel(), np.arange(n + 1) * 3))
    assert (~(a == b).any(axis=1)).sum() <= 2


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 600).astype(np.uint64)
    b = np.concatenate([a[:480], rng.integers(0, 1 << 62, 120).astype(np.uint64)])
    sig = neardup.superminhash(np.concatenate([a, b]), np.array([0, 600, 1200]))
    assert abs((sig[0] == sig[1]).mean() - 480 / 720) < 0.15


@pytest.mark.parametrize("block", [decontam.BLOCK_WINDOWS, 40])
def test_decontamination(spark, docs, rows, block):
    bench = [(1, texts()[30]), (2, "One"), (3, None), (4, "  "), (1, texts()[30]), (10, texts()[50]), (11, thue_morse(11)[0]), (12, f"a b {thue_morse(12)[1]}")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = words(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + min(10, len(w))])].add(i)
    expected = collections.Counter()
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[tuple(w[k : k + n])]
        expected[(i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit))] += 1
    frame = spark.createDataFrame(bench, "item_id long, text string")
    assert collections.Counter(map(tuple, decontam.find(docs, frame, block_windows=block).collect())) == expected


def test_pii_base_spans_and_redaction(spark, docs, rows):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0

    def base(t):
        out = []
        for k, kind in enumerate(patterns):
            for m in re.finditer(patterns[kind], t):
                d = re.sub("[^0-9]", "", m.group())
                if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    rng = random.Random(3)
    parts = [*"aB9.@+- _%é😀12340()", "@a.b", "1.2.3.4", "+1 (234) 555-7713", "4111 1111 1111 1111", "x@y.z_c@d.e"]
    noise = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(1500)] + [(-1, "1" * 30_000), (-2, "a" * 30_000)]
    some = noise + rows
    found = pii.detect(spark.createDataFrame(some, "doc_id long, text string")).collect()
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in found)
    assert collections.Counter((r.doc_id, tuple(map(tuple, r.base))) for r in found) == collections.Counter((i, tuple(base(t or ""))) for i, t in some)
    red = {r.a: r.text for r in pii.redact(spark.createDataFrame([(1, "mail a@b.cd, +1 (234) 555-7713!"), (2, None), (3, "x")], "a int, text string")).collect()}
    assert red == {1: "mail [EMAIL], [PHONE]!", 2: None, 3: "x"}


def test_pii_numbers_that_touch(spark):
    cases = {
        "pay 4845168114407329 4845168114407329": ["4845168114407329"] * 2,
        "card 7536784127813050 4845168114407329": ["7536784127813050", "4845168114407329"],
        "card 4111 1111 1111 1111 12/26": ["4111 1111 1111 1111"],
        "tel 415-555-2671 2024-05-01": ["415-555-2671"],
        "call 415-555-2671 415-555-2672 (415) 555-2673": ["415-555-2671", "415-555-2672", "(415) 555-2673"],
        "order 2024-05-01 2024-06-01": [],
        "id=1 2 3 4 5 6 7 8 9 10 11 12 13 14 15": [],
    }
    got = {r.text: [r.text[x.s : x.e] for x in r.spans] for r in pii._with_spans(spark.createDataFrame([(t,) for t in cases], "text string")).collect()}
    assert got == cases


def test_pii_secrets(spark, data):
    """Precision and recall 1 on documents, where secrets are ``token = "<40 hex digits>"``; other long runs stay."""
    cases = {
        'api_key="sk-9f8a7c6d5e4f3a2b1c0d9e8f"': ["sk-9f8a7c6d5e4f3a2b1c0d9e8f"],
        "password: Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZg": ["Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZg"],
        "see section-2024-article-number of covid-19-vaccine": [],
        "order 20240501123456": [],
        "http://www.site.org/2024/article-number-7": [],
        "x" * 30_000 + "1": [],
    }
    got = {r.text: [r.text[x.s : x.e] for x in r.spans if pii.KINDS[x.k] == "secret"] for r in pii._with_spans(spark.createDataFrame([(t,) for t in cases], "text string")).collect()}
    assert got == cases
    docs = spark.read.parquet(f"{data.replace("sf0.001", "sf0.01")}/documents.parquet").select("doc_id", "text")
    found = {(r.doc_id, x.s, x.e) for r in pii.detect(docs).collect() for x in r.spans if pii.KINDS[x.k] == "secret"}
    want = {(r.doc_id, m.start(1), m.end(1)) for r in docs.collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text or "", re.I)}
    assert found == want and want


def test_pii_models_score_as_in_plain_python(spark):
    for kind in ("card", "phone", "email", "secret"):
        names, trees, limit = pii.model(spark, kind)
        sample = pii._examples(spark, kind)
        made = pii._made(kind, F.col("v"), F.col("front"), F.col("left"), F.col("back"))
        rows = sample.select(*[c.cast("int").alias(n) for n, c in made.items()], "label", "held")
        rows = rows.select("*", pii._margin(spark, kind, {n: F.col(n) for n in names}).alias("margin")).collect()
        assert all(abs(pii._apply(trees, tuple(r[n] for n in names)) - limit - r.margin) < 1e-6 for r in rows)
        taken = [r for r in rows if r.held and r.margin >= 0]
        assert sum(r.label for r in taken) >= 0.9 * len(taken) > 0


def test_pii_numbers_are_all_proposed(spark):
    rng = random.Random(4)
    parts = ["1", "22", "4444", "55555", "9876543210", " ", "-", ".", " (", ") ", "+", "/", "a", "é", "  "]
    some = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]
    for r in spark.createDataFrame([(t,) for t in some], "text string").select("text", pii.numbers(F.col("text")).alias("runs")).collect():
        want = set()
        for run in re.finditer(r"[0-9][ ().0-9/-]*", r.text):
            groups = [(run.start() + g.start(), run.start() + g.end()) for g in re.finditer("[0-9]+", run[0])]
            for i, (s, _) in enumerate(groups):
                start = s - bool(re.search(r"(^|[^0-9A-Za-z])[+(]$", r.text[:s]))
                for _, e in groups[i:]:
                    if 9 <= len(re.sub("[^0-9]", "", r.text[s:e])) <= 19 and not re.search("[0-9A-Za-z]$", r.text[:start]) and not re.match("[0-9A-Za-z]", r.text[e:]):
                        want.add((start, e, r.text[start:e]))
        found = [(x.s, x.e, x.v) for run in r.runs for x in run]
        assert set(found) == want and len(found) == len(want)


def test_url_filter(spark):
    rng = random.Random(5)
    made = [f"https://h{rng.randrange(9)}.example.{tld}/{lang}/{rng.randrange(999)}" for tld in ("org", "com", "net") for lang in ("en", "de", "fr", "es") for _ in range(60)]
    urls_ = [*made, None, "", "no scheme", "HTTP://A.ORG", "http://x.example.ORG/es/1?q=/fr/#y", "http://a.com?x=/fr/"]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string"), URL_RULES).collect()}
    for i, u in enumerate(urls_):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
            path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best.host + best.path)
        assert got[i].verdict == best.verdict if best else got[i].verdict in ("allow", "block")
    net = lambda lang: [r for r in got.values() if r.host.endswith(".net") and r.path.startswith(f"/{lang}/")]
    assert max(r.score for r in net("de")) < min(r.score for r in net("fr"))
    assert sum(r.verdict == "allow" for r in net("fr")) > 50


def test_url_scores_are_those_of_exact_counts(spark):
    rng = random.Random(9)
    made = [f"http://x.{tld}/{''.join(rng.choice(letters) for _ in range(60))}" for tld, letters in (("org", "abcdefghijklmnop"), ("com", "klmnopqrstuvwxyz"), ("net", "abcdefghijklmnop")) for _ in range(400)] + ["http://x.org/1😀", "", None]
    some = [urls.Rule("allow", "org", "/"), urls.Rule("block", "com", "/")]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in urls.judge(pages, some).collect()}
    held = {r.page_id for r in pages.selectExpr("page_id", f"pmod(xxhash64(url), {urls.HELD_OUT}) = 0 as held").collect() if r.held}
    text = [re.sub("[0-9]", "0", (u or "").split("://")[-1]).encode() for u in made]
    grams = lambda t: [[(tuple(t[j] if j >= 0 else -1 for j in range(i - k, i)), t[i]) for k in range(urls.ORDER + 1)] for i in range(len(t))]
    seen, hit = collections.Counter(), collections.Counter()
    for i, t in enumerate(text):
        if got[i].rule and i not in held:
            for c, b in (x for g in grams(t) for x in g):
                seen[got[i].verdict, c] += 1
                hit[got[i].verdict, c, b] += 1
    for i, t in enumerate(text):
        total = 0.0
        for g in grams(t):
            p = {"allow": 1 / 256, "block": 1 / 256}
            for c, b in g:
                p = {v: (hit[v, c, b] + urls.STRENGTH * p[v]) / (seen[v, c] + urls.STRENGTH) for v in p}
            total += np.log(p["allow"]) - np.log(p["block"])
        assert abs(got[i].score - total / max(len(t), 1)) < 2e-6


def test_bpe_round_trip(docs, rows):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    expected = collections.Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[(i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False))] += 1
    assert collections.Counter((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.decode(bpe.encode(docs, path), path).collect()) == expected
    assert collections.Counter((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.round_trip(docs, path).collect()) == expected


def test_bpe_splitter_on_odd_characters():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    rng = random.Random(1)
    parts = [*" \n\t'stmdrevlxé中１٣½!,.''   \u0085ⅷ😀´ʼ", "<|endoftext|>", "'s", "'ll", "'re", "  "]
    some = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    some += ["".join(chr(c) for c in (rng.randrange(0x110000) for _ in range(100)) if not 0xD800 <= c < 0xE000) for _ in range(200)]
    some += [w for n in (10, 11, 12) for w in thue_morse(n)]
    got = bpe.LocalEncoder(path)(some)
    assert [x.tolist() for x in got] == [x.ids for x in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]


def test_packing(docs, rows):
    rng = random.Random(3)
    for _ in range(200):
        length = rng.choice([1, 2, 7, 16, 100])
        sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 60))]
        free = []
        for s in sorted(sizes, reverse=True):
            fits = [f for f in free if f >= s]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - s)
            else:
                free.append(length - s)
        got = packing.best_fit(sizes, length)
        assert sorted(sum(got, [])) == list(range(len(sizes))) and sorted(length - sum(sizes[i] for i in r) for r in got) == sorted(free)
    path = tokenizer_file("byte_bpe_50k.json")
    once = docs.dropDuplicates(["doc_id"]).filter("doc_id is not null")
    packed = packing.pack(once, path, length=64)
    ids = {r.doc_id: bytes(r.ids) for r in bpe.encode(once, path).collect()}
    back = {r.doc_id: bytes(r.ids) for r in packing.unpack(packed).collect()}
    assert {i: b for i, b in ids.items() if b} == back
    for r in packed.collect():
        positions = np.frombuffer(r.positions, "<u4")
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert positions[a:b].tolist() == list(range(b - a))


def test_html(spark):
    page = '<html><head><title>no</title></head><body><header>H</header><nav>m</nav><article><h1>T&amp;t</h1><p>a  b<br>c <b>d</b>e<p>f&nbsp;g<ul><li>x<li>y</ul><div class="notice">no</div><section class="comments"><p>zz</p></section><form>q</form><!-- c --><script>if(a<b)"</p>"</script>tail<aside>s</aside></article><footer>F</footer>'
    shared = [f"<body><div>Welcome to our site</div><div>{w} tells a story of its own</div></body>" for w in "one two three four five six seven eight".split()]
    rows_ = [(1, "http://a.org/", page), (2, None, None), (3, "x", ""), (1, "http://a.org/", page)] + [(10 + i, "http://b.org/x", h) for i, h in enumerate(shared)]
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in html.extract(spark.createDataFrame(rows_, "page_id long, url string, html string")).collect())
    text = "T&t\na b c de\nf g\nx\ny\ntail"
    assert got[(1, text, len(text))] == 2 and got[(2, "", 0)] == 1 and got[(3, "", 0)] == 1
    assert got[(10, "one tells a story of its own", 28)] == 1  # what the host repeats is gone


def test_html_style_tree_inside_articles(spark):
    """What nearly every article of a host shows goes, a host's copies of one article stay; against a tree in plain Python."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    pages = []
    for host in ("many.org", "few.org"):
        for n in range(30 if host == "many.org" else 3):
            blocks = [" ".join(word() for _ in range(9)) for _ in range(rng.randrange(1, 5))] + ["Read more on our site"] * (n % 15 > 0) + ["Seen on a few pages"] * (n % 5 == 0)
            for copy in range(12 if n == 3 else 1):
                pages.append((f"http://{host}/{n}/{copy}", blocks, f"<body><p>top {copy}</p><article>{''.join(f'<p>{b}</p>' for b in blocks)}</article></body>"))
    count, mains = collections.Counter(), collections.Counter()
    for host, blocks in {(u.split("/")[2], tuple(b)) for u, b, _ in pages}:
        mains[host] += 1
        count.update((host, b) for b in set(blocks))
    styles = collections.defaultdict(collections.Counter)
    for host, blocks in {(u.split("/")[2], tuple(b)) for u, b, _ in pages}:
        styles[host][""] += 1  # a paragraph has no child tags here

    def low(host, b):
        m, n = mains[host], count[host, b]
        return m >= html.PAGES and n > 1 and (1 - html.PRESENTATION) * (1 - np.log(n) / np.log(m)) < html.LEAST_INSIDE

    some = [(i, u, h, "x") for i, (u, _, h) in enumerate(pages)] + [(None, pages[0][0], pages[0][2], "x"), (900, None, "<p>a" + "<div>" * 3000 + "deep" + " w" * 200_000, "x")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(some, "page_id long, url string, html string, text string")).collect()}
    removed = 0
    for i, (u, blocks, _) in enumerate(pages):
        host = u.split("/")[2]
        assert got[i] == "\n".join(b for b in blocks if not low(host, b))
        removed += sum(low(host, b) for b in blocks)
    assert removed > 20 and any("Seen on a few pages" in t for t in got.values()) and got[None] == got[0]
    assert got[900] == "a\ndeep" + " w" * 200_000


def test_substring_dedup(docs, rows):
    first = {}
    for i, t in rows:
        w = re.findall(SPACE, t or "")
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    expected = collections.Counter()
    for i, t in rows:
        w = re.findall(SPACE, t or "")
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                keep[k : k + 50] = [False] * 50
        left = [x for x, y in zip(w, keep, strict=True) if y]
        expected[(i, len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest())] += 1
    got = substring.dedup(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected
    held = collections.defaultdict(list)
    for i, t in rows:
        held[i].append(re.findall(SPACE, t or ""))
    factors = 0
    for r in got:  # a factor is a stretch of one reference text, and the factors cover what is removed
        covered = set()
        for start, size, source, place in zip(r.starts, r.sizes, r.sources, r.places, strict=True):
            assert source < r.doc_id and size >= 50
            assert any(s[place : place + size] == w[start : start + size] and len(s) >= place + size for s in held[source] for w in held[r.doc_id])
            covered |= set(range(start, start + size))
            factors += 1
        assert len(covered) == r.n_removed
    assert factors > 20


def test_token_counts(docs, rows):
    path = tokenizer_file("piece_bpe_32k.model")
    model = tokencount.Counter(path)
    rng = random.Random(2)
    parts = [*"  \n\tabcdefé中!▁ \r<s>{}();", "the", "  ", "    ", "<s>", "ing"]
    some = ["", " ", "▁", "a ", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 80))) for _ in range(3000))]
    expected = model.whole(some)
    assert model.counts([t.encode() for t in some]).tolist() == expected
    assert [model.spliced(t.encode(), 10, 2) for t in some[:800]] == expected[:800]
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(docs, path, limit=100, chunk=300, overlap=8).collect())
    assert got == collections.Counter((i, len((t or "").encode()), n, n > 100) for (i, t), n in ((r, model.whole([r[1] or ""])[0]) for r in rows))


def test_quality_rules(spark, docs, rows):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, None, 0), (None, 1, 0), (99_999, 1, 0)], "doc_id long, quality int, toxic int")
    expected = collections.Counter()
    for i, t in rows:
        t = t or ""
        w = re.findall(SPACE, t)
        triples = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        count = collections.Counter(triples)
        covered = {j + k for j, x in enumerate(triples) if count[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        expected[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed, not failed)] += 1
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert collections.Counter(map(tuple, quality.judge(docs, labels).select(columns).collect())) == expected
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(0, 10), (3, 400), (1, 1000), (5, 2000), (12, 5000)]
    frame = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.004).alias("p"))
    for r in frame.collect():
        exact = sum(comb(r.n, i) * 0.004**i * 0.996 ** (r.n - i) for i in range(r.k + 1)) if r.k < r.n * 0.004 else 1.0
        assert exact - 1e-9 <= r.p <= exact * 1.0001 + 1e-9


def test_quality_cutoffs_are_certified(spark):
    from pyspark.sql import functions as F

    good = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), i * 7 + F.col("id"))), " "))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 8 == 0, F.replace(good, F.lit(" "), F.lit("%% "))).otherwise(good).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", (F.col("doc_id") % 8 != 0).cast("int").alias("quality"))
    got = quality.judge(docs, labels).groupBy((F.col("doc_id") % 8 != 0).alias("good"), "kept").count().collect()
    assert {(r.good, r.kept): r["count"] for r in got} == {(True, True): 3500, (False, False): 500}


def test_empty_tables(spark, empty):
    path, pieces = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    frames = [neardup.group(empty), decontam.find(empty, bench), pii.detect(empty), urls.judge(pages, URL_RULES), bpe.decode(bpe.encode(empty, path), path), packing.pack(empty, path), html.extract(pages), substring.dedup(empty), tokencount.count_tokens(empty, pieces), quality.judge(empty, labels)]
    assert [f.count() for f in frames] == [0] * 10
