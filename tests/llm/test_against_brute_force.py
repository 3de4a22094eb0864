"""Operators against plain versions on the small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import components, html, langid, packing, pii, quality, queries, sampling, simhash, substring, tokencount

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_op3(spark, sf_dir, docs, monkeypatch):
    monkeypatch.setattr(substring, "FLUSH_WINDOWS", 5_000)
    first, want = {}, {}
    for i in sorted(docs):
        words = WORD.findall(docs[i])
        gone = [False] * len(words)
        for k in range(len(words) - 49):
            if first.setdefault(tuple(words[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        want[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op3_substring_dedup(spark, sf_dir).collect()}
    assert found == want


def test_op3_over_partitions(spark, docs):
    """Windows judged by their buckets, not inside one task."""
    frame = spark.createDataFrame([(i, docs[i]) for i in sorted(docs)], "doc_id long, text string")
    one = {r["doc_id"]: r["kept_text"] for r in substring.substring_dedup(frame.coalesce(1)).collect()}
    many = {r["doc_id"]: r["kept_text"] for r in substring.substring_dedup(frame.repartition(9)).collect()}
    assert one == many


def test_op3_texts_of_one_id(spark):
    """Rows that repeat an id and differ in text, one of them shorter than the places cut from the other."""
    shared = [f"s{k}" for k in range(60)]
    rows = [(1, " ".join(shared)), (5, " ".join([f"a{k}" for k in range(90)] + shared)), (5, " ".join(f"b{k}" for k in range(55))), (5, " ".join(shared[:55]))]
    for parts in (1, 4):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found = sorted((r["doc_id"], r["n_words"], len(r["kept_text"].split())) for r in substring.substring_dedup(frame).collect())
        assert found == [(1, 60, 60), (5, 55, 0), (5, 55, 55), (5, 150, 90)]


def test_op6_long_numbers():
    text = "0" * 6000 + ".1.2.3 and 1.2.3." + "9" * 6000
    assert [s for s in pii.find_spans(text) if s[0] == "ip"] == [("ip", 0, 6006)]


def test_op4(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids = vectors.vec_id.to_numpy()
    m = np.floor(256 * np.stack(vectors.embedding).astype(np.float64)).astype(np.int64)
    want = []
    for q in np.flatnonzero(ids % 50 == 0):
        score = m @ m[q]
        best = [k for k in np.lexsort((ids, -score)) if ids[k] != ids[q]][:5]
        want += [(ids[q], n + 1, ids[k], score[k]) for n, k in enumerate(best)]
    found = queries.op4_exact_topk(spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_op5(spark, sf_dir, docs):
    for r in queries.op5_quality_rules(spark, sf_dir).collect():
        text = docs[r["doc_id"]]
        words = WORD.findall(text)
        seen, again = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        counts = collections.Counter(windows)
        repeat = len({k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(8)})
        failed = len(words) < 20 or 100 * repeat > 30 * len(words)
        symbols = sum(c in "#*$%&|<>" for c in text)
        assert tuple(r)[1:7] == (len(words), sum(map(len, words)), symbols, again, repeat, failed)
        assert not (failed and r["kept"])


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 12, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", " ", "-", ".", "@", "+", "1", "22", "255", "256", "4111111111111111", "(", ")", "\n", "_", "token = ", "IBAN ", "http://", "٣"]), max_size=30).map("".join))
def test_base_spans_of_random_texts(text):
    assert [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == plain_spans(text)


def test_op6(spark, sf_dir, docs):
    for r in queries.op6_pii(spark, sf_dir).collect():
        base = plain_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % s for s in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in base) for k in pii.BASE_KINDS]


def test_op7(spark, sf_dir, docs):
    pieces = tokencount.vocabulary(public_tokenizers.path(tokencount.VOCABULARY))
    longest = max(len(w) for w, _ in pieces)

    def greedy(word):
        n = at = 0
        while at < len(word):
            at = next(j for j in range(min(len(word), at + longest), at, -1) if (word[at:j], j == len(word)) in pieces)
            n += 1
        return n

    lowered = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "lower(text)").collect()}
    for r in queries.op7_token_counts(spark, sf_dir).collect():
        words = (lowered[r["doc_id"]] or "").encode().split()
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(map(greedy, words)))


def test_op8_held_out_accuracy(spark, sf_dir):
    found = queries.op8_language_id(spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    both = found.where("held_out").join(truth, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in both) >= 0.95 * len(both) > 0
    assert all(0 <= r["score"] <= 1 for r in both)


def test_forward_sums_all_segmentations():
    path = public_tokenizers.path(langid.VOCABULARY)
    known = {p: k for k, p in enumerate(langid.sentence_pieces(path)) if p}
    p = langid.start(path)

    def total(word):
        if not word:
            return 1.0
        out = langid.FALLBACK * total(word[1:])
        return out + sum(p[0, known[word[:j]]] * total(word[j:]) for j in range(1, len(word) + 1) if word[:j] in known)

    for word in (b"the", b"token", "café".encode(), b"q"):
        data = np.frombuffer(word, np.uint8)
        found = langid.word_scores(path, data, np.array([0]), np.array([len(word)]), p)[0, 0]
        assert found == pytest.approx(math.log(total(b" " + word)))


def test_op9(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = queries.op9_packing(spark, sf_dir).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, text in docs.items():
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 2048)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * -(-total // 2048) + 1


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 40), max_size=12))
def test_plan_is_a_packing(counts):
    slots = packing.plan(counts, 20)
    used = collections.defaultdict(list)
    for length in counts:
        ranks = sorted((a, b) for n, a, b, _, _ in slots if n == length)
        assert [a for a, _ in ranks] == [0, *[b for _, b in ranks[:-1]]] and ranks[-1][1] == counts[length]
    for length, a, b, first, offset in slots:
        for k in range(b - a):
            used[first + k].append((offset, length))
    for held in used.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 20
    # best-fit decreasing one piece at a time opens as many
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is None:
                rooms.append(20 - length)
            else:
                rooms[rooms.index(fit)] -= length
    assert len(used) == len(rooms)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_tokenizers_agree(text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    assert packing.encode(text.encode("utf-8", "ignore")) == plain.encode(text.encode("utf-8", "ignore").decode(), add_special_tokens=False).ids


def test_special_token_goes_to_the_reference():
    assert packing.encode(b"a<|endoftext|>b") == [64, 50256, 65]


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_op10(spark, sf_dir, docs):
    found = {r["doc_id"]: r for r in queries.op10_simhash(spark, sf_dir).collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    assert {i: f"{p:016x}" for i, p in prints.items()} == {i: r["fingerprint"] for i, r in found.items()}
    label = {i: i for i in docs}
    changed = True
    pairs = [(a, b) for a in docs for b in docs if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    assert label == {i: r["component_id"] for i, r in found.items()}


def test_simhash_links_planted_and_hot_cells(spark):
    """Fingerprints at up to 4 bits link whatever the bits, also where cells are split into many blocks."""
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 40)
    values = {int(b) for b in base}
    for b in base:
        for _ in range(12):
            x = int(b) % 2**64
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(bit)
            values.add(x - (x >> 63 << 64))
    values = sorted(values)
    u = np.array(values, np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 4
    a, b = np.nonzero(near)
    signed = np.array(values, np.int64)
    want = dict(zip(*(x.tolist() for x in components.forest(signed[a], signed[b]))))
    for block in (4, 1024):
        links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), block=block)
        found = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
        assert {v: found.get(v, v) for v in values} == {v: want.get(v, v) for v in values}


def test_fingerprints_are_dealt_before_they_are_spread(spark):
    fps = spark.range(5000).select(F.xxhash64("id").alias("fp")).distinct()
    dealt = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert dealt.count("Generate explode") >= 2 and "hashpartitioning(xxhash64(fp" in dealt
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = simhash.cells(fps.repartition(n, F.xxhash64("fp"))).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == n and max(r["count"] for r in sizes) < 1.5 * 5000 * simhash.CELLS / n


def test_embedding_counts_segments_and_bounds_the_distance(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**32, 300).tolist()
    found = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k long, h long").orderBy("k").select(simhash.embedding(F.col("h"))).collect()]

    def plain(h):
        bit = [h >> k & 1 for k in range(32)]
        rows = [bit[k] + bit[k + 1] for k in range(0, 32, 2)]
        columns = [bit[k + j] + bit[k + j + 2] for k in range(0, 32, 4) for j in (0, 1)]
        return rows + columns

    counts = [[v % 2**64 >> 2 * k & 3 for k in range(32)] for v in found]
    assert counts == [plain(h) for h in x]
    for a, b in zip(x, x[1:]):
        assert sum(abs(p - q) for p, q in zip(plain(a), plain(b))) <= 2 * (a ^ b).bit_count()


def test_components_of_long_paths_and_hubs(spark):
    n = 700
    path = [(k, k + 1) for k in range(n)] + [(5000, 5000 + k) for k in range(1, 300)]
    values = spark.createDataFrame([(k, -k % 9000) for k in [*range(n + 1), *range(5000, 5300)]], "node long, value long")
    found = {r["node"]: (r["component"], r["least"]) for r in components.connected_components(spark.createDataFrame(path, "a long, b long"), values).collect()}
    assert {found[k] for k in range(n + 1)} == {(0, 0)} and {found[k] for k in range(5000, 5300)} == {(5299, 3701)}


def test_sampling_is_without_replacement():
    """First draws follow the lattice, and inclusion scores make unbiased totals."""
    v = sampling.vocabulary(public_tokenizers.path(sampling.VOCABULARY), 0.25)
    text, n = b"the at", 4_000
    data, offsets = np.frombuffer(text * n, np.uint8), np.arange(n + 1) * len(text)
    found = list(sampling.Block(v, data, offsets, np.arange(n)).samples(3))
    left = found.pop()
    first, totals, seen = collections.Counter(), np.zeros(n), [set() for _ in range(n)]
    for number, (active, log_prob, score, pieces, begin) in enumerate(found):
        bounds = begin[np.arange(n + 1) * 2]
        for r in range(n):
            ids = tuple(pieces[bounds[r] : bounds[r + 1]].tolist())
            assert ids not in seen[r]
            seen[r].add(ids)
            first[ids, math.exp(log_prob[r])] += number == 0
            totals[r] += math.exp(log_prob[r]) / -math.expm1(-math.exp(log_prob[r] - left[r]))
    for (ids, p), count in first.items():
        if p > 0.02:
            assert count / n == pytest.approx(p, abs=4 * math.sqrt(p / n))
    assert totals.mean() == pytest.approx(1, abs=0.1)


def all_segmentations(v, text):
    """Every segmentation of ``text`` with a space in front, as {ids: probability}, from the vocabulary alone."""
    text = b" " + text
    known = {w: k for k, w in enumerate(v.bytes) if w and len(w) > 1 or k not in set(v.byte_ids.tolist())}
    weight = lambda k, n: v.scaled[k] / sampling._TILT**n

    def of(at):
        if at == len(text):
            return [((), 1.0)]
        out = [((k, *rest), weight(k, 1) * p) for k in [int(v.byte_ids[text[at]])] for rest, p in of(at + 1)]
        for j in range(at + 1, len(text) + 1):
            k = known.get(text[at:j])
            if k is not None and v.bytes[k]:
                out += [((k, *rest), weight(k, j - at) * p) for rest, p in of(j)]
        return out

    found = dict(of(0))
    total = sum(found.values())
    return {ids: p / total for ids, p in found.items()}


@pytest.mark.parametrize("text", [b"the", b"a  b", b"of   it"])
def test_sampling_against_enumeration(text):
    """Probabilities, distinctness and the set of all segmentations, runs of spaces included."""
    v = sampling.vocabulary(public_tokenizers.path(sampling.VOCABULARY), 1.0)
    want = all_segmentations(v, text)
    block = sampling.Block(v, np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.array([7]))
    k = len(want) + 2 if len(want) < 60 else 60
    found = list(block.samples(k))
    left = found.pop()
    got = {tuple(pieces.tolist()): math.exp(log_prob[0]) for active, log_prob, _, pieces, _ in found if active[0]}
    assert len(got) == min(k, len(want)) and got.keys() <= want.keys()
    for ids, p in got.items():
        assert p == pytest.approx(want[ids], rel=1e-9)
    assert (left[0] == -np.inf) == (k >= len(want))


def test_tiny_alternatives_are_left_and_drawn():
    """Alternatives far below the digits of 1 - p."""
    v = sampling.Vocabulary(public_tokenizers.path(sampling.VOCABULARY), 1.0)
    piece = v.bytes.index(b" the")
    v.scaled[:] = np.where(np.arange(len(v.scaled)) == piece, v.scaled[piece], v.scaled * 1e-9)
    word = np.frombuffer(b" the", np.uint8)
    for lattice in (sampling.Lattice(v, word[None, :]), sampling.LongLattice(v, word)):
        only = np.full(5, -1, np.int32)
        only[4] = piece
        left = sampling.Others(lattice, 0, [only]).left()
        assert 0 < left < 1e-12
        assert sampling.Others(lattice, 0, [only]).draw(np.uint64(1))[0][4] != piece
    block = sampling.Block(v, np.frombuffer(b"the", np.uint8), np.array([0, 3]), np.array([1]))
    assert sum(bool(f[0][0]) for f in list(block.samples(4))[:-1]) == 4


def test_sampling_ignores_neighbours(spark, docs):
    frame = spark.createDataFrame([(i, docs[i]) for i in sorted(docs)[:60]], "doc_id long, text string")
    one = sorted(map(tuple, sampling.sample_segmentations(frame.coalesce(1)).select("doc_id", "sample", "ids_crc32").collect()))
    many = sorted(map(tuple, sampling.sample_segmentations(frame.repartition(7)).select("doc_id", "sample", "ids_crc32").collect()))
    assert one == many


def article(source):
    import html as entities

    inside = re.search("<article>(.*?)</article>", source, re.S)
    parts = re.split("</?(?:p|h1)>", inside[1]) if inside else []
    want = [" ".join(entities.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
    return [w for w in want if w]


def test_op1(spark, sf_dir):
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = queries.op1_html_extraction(spark, sf_dir).collect()
    for r in found:
        assert r["text"] == "\n\n".join(article(pages[r["page_id"]]))
        assert r["n_chars"] == len(r["text"])
    assert sum(r["n_removed"] for r in found) >= 3 * len(found)  # menu, advert and footer of each page


def test_op1_without_articles_and_names(spark, sf_dir):
    """The style tree finds the text where nothing is named: <article> is a <div> and classes are gone."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plain = F.regexp_replace(F.regexp_replace("html", "<(/?)article>", "<$1div>"), ' class="[^"]*"', "")
    want = {r["page_id"]: article(r["html"] or "") for r in pages.collect()}
    right = found = wanted = 0
    for r in html.extract_main_text(pages.withColumn("html", plain)).select("carried.page_id", "main_text").collect():
        a, b = collections.Counter(r["main_text"].split("\n\n")), collections.Counter(want[r["page_id"]])
        size = lambda c: sum(len(x) * n for x, n in c.items())
        right, found, wanted = right + size(a & b), found + size(a), wanted + size(b)
    assert right >= 0.98 * found and right >= 0.99 * wanted


def plain_style_nodes(pages):
    """Facts of style nodes from the definition, page by page, over pages of one host."""
    once = {p.content(): p for p in (html.Tree(page.pack()) for page in pages)}.values()
    shapes, texts, sums = collections.defaultdict(list), collections.defaultdict(lambda: collections.defaultdict(int)), collections.defaultdict(lambda: [0, 0, 0])
    for page in once:
        for node, kind, feature, chars, links, total in page.features():
            if kind:
                texts[node][feature] += 1
            else:
                shapes[node].append(feature)
                sums[node] = [a + b for a, b in zip(sums[node], (chars, links, total))]
    out = {}
    for node, found in shapes.items():
        n = len(found)
        if n > 1:
            entropy = -sum(c / n * math.log(c / n, n) for c in collections.Counter(found).values())
            repeat = [math.log(c, n) for c in texts[node].values()]
            chars, links, total = sums[node]
            out[node] = (n, entropy, 1 - sum(repeat) / len(repeat) if repeat else 1.0, len(set(found)), links / max(1, chars), chars / max(1, total))
    return out


def test_style_nodes_follow_the_definition(spark):
    rows = [(k, f"http://site.example/{k}", site(k // 2, "<ul><li><a>next</a></ul>" * (k % 3))) for k in range(12)]
    want = plain_style_nodes([html.Page(source, html.host_of(url)) for _, url, source in rows])
    frame = spark.createDataFrame(rows, "page long, url string, html string").withColumn("carried", F.lit(1)).repartition(3)
    parsed = frame.mapInArrow(html._parse, "page long, parsed binary, carried int")
    found = {r["node"]: tuple(r)[1:] for r in html.style_nodes(html.features_of(parsed)).collect()}
    assert found.keys() == want.keys() and len(found) > 5
    for node, facts in want.items():
        assert found[node] == pytest.approx(facts, abs=1e-9)


def test_pages_are_parsed_once(spark, sf_dir):
    plan = queries.op1_html_extraction(spark, sf_dir)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert text.count("_parse(") == 1 and "ReusedExchange" in text


@pytest.mark.parametrize(
    "source",
    ["<a " * 350_000, "<script " * 130_000, "<div>" * 200_000, "<div>" * 100_000 + "</p></b></i>" * 40_000, "<svg>" * 200_000, '<a ">" ' * 160_000, "<!--" * 250_000, "<p class='" * 100_000, "<" * 1_000_000],
)
def test_broken_markup_is_linear(source):
    import time

    begin = time.process_time()
    html.main_text(html.Page(source + "<p>text", "h").pack(), {})
    assert time.process_time() - begin < 4


@pytest.mark.parametrize(
    "name, kept",
    [("<p class='share price'>The share price rose by five points today.</p>", True), ("<p class='banner-history'>The banner was made in 1900 by hand.</p>", True),
     ("<div class='related-work'><p>Work by others that this story builds on, told at some length.</p></div>", True), ("<div class='related'><a href=x>Work by others that this story links to</a></div>", False)],
)
def test_names_alone_remove_nothing(name, kept):
    for box in ("article", "div"):
        found, _ = html.main_text(html.Page(f"<html><body><{box} class=post>{STORY}{name}</{box}></body></html>", "h").pack(), {})
        assert ("five points" in found or "by hand" in found or "Work by" in found) == kept


def site(k, extra=""):
    body = "".join(f"<p>Paragraph {k} {n} of its own words {k * 31 + n}.</p>" for n in range(5))
    return f"<html><body><div class=wrap><div class=intro-x><p>Join our list for weekly letters</p></div><div class=story-x>{body}</div>{extra}<div class=legal-x>All rights reserved by the site</div></div></body></html>"


def test_style_tree_removes_what_a_site_repeats(spark):
    rows = [(k, f"http://site.example/{k}", site(k)) for k in range(8)]
    found = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for r in found.select("carried.page_id", "main_text").collect():
        k = r["page_id"]
        assert r["main_text"] == "\n\n".join(f"Paragraph {k} {n} of its own words {k * 31 + n}." for n in range(5))


def test_style_tree_leaves_copies_alone(spark):
    rows = [(k, f"http://site.example/{k}", site(1)) for k in range(8)]
    found = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert all("Paragraph 1 0" in r["main_text"] for r in found.collect())


STORY = "".join(f"<p>The story goes on with sentence {n} and some more words.</p>" for n in range(6))
TEASERS = "".join(f"<article class=card><p>Teaser {n} of another page</p></article>" for n in range(3))


@pytest.mark.parametrize(
    "body",
    [
        f"<div class=post>{STORY}</div><section class=related>{TEASERS}</section>",
        f"<div class=post>{STORY}</div><aside>{TEASERS}</aside><nav>{TEASERS}</nav>",
        f"<article>{STORY}</article><section class=related>{TEASERS}</section>",
        f"<article>{STORY}<div class=comments><article><p>A comment that is{' very' * 80} long</p></article></div></article>",
        f"<div class=sidebar-layout><article>{STORY}</article></div><div class=comments>{TEASERS * 9}</div>",
        f"<form id=aspnet><main><div class=post>{STORY}</div></main></form>",
        f"<div class=post>{STORY}</div>",
    ],
)
def test_articles_are_evidence_only(body):
    found, _ = html.main_text(html.Page(f"<html><body>{body}</body></html>", "h").pack(), {})
    assert found == "\n\n".join(f"The story goes on with sentence {n} and some more words." for n in range(6))


def test_unnamed_teasers_do_not_replace_the_story():
    teasers = "".join(f"<article><p>Teaser {n} of another page</p></article>" for n in range(30))
    found, _ = html.main_text(html.Page(f"<html><body><div class=post>{STORY}</div><div>{teasers}</div></body></html>", "h").pack(), {})
    assert all(f"sentence {n} " in found for n in range(6))


def repeated(k):
    """A short article beside a longer notice and other boxes that the host repeats."""
    boxes = "".join(f"<div class=box-{c}><p>Box {c} of the site</p><span></span></div>" for c in "abcdefgh")
    notice = "".join(f"<p>The terms of use of this site, clause {n}, are long and on every page.</p>" for n in range(9))
    return f"<html><body><div class=story-x><p>Short news {k}.</p></div>{boxes}<div class=terms-x>{notice}</div></body></html>"


@pytest.mark.parametrize("pages, copies", [(12, 1), (2, 1), (3, 9)])
def test_style_tree_removes_what_outweighs_the_article(spark, pages, copies):
    rows = [(k, f"http://short.example/{k}/{c}", repeated(k)) for k in range(pages) for c in range(copies if not k else 1)]
    found = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {(r["page_id"], r["main_text"]) for r in found.select("carried.page_id", "main_text").collect()} == {(k, f"Short news {k}.") for k in range(pages)}
    assert found.count() == len(rows)


def test_style_tree_keeps_a_page_of_repeated_text_only(spark):
    rows = [(k, f"http://short.example/{k}", repeated(k) if k else repeated(k).replace("<p>Short news 0.</p>", "")) for k in range(6)]
    found = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    texts = {r["page_id"]: r["main_text"] for r in found.select("carried.page_id", "main_text").collect()}
    assert "clause 8" in texts[0] and texts[1] == "Short news 1."


SLOTS = {
    "an advert in the article": lambda k, story, own: f"<article>{story}<div class='ad-slot'><p>{own}</p></div></article>",
    "a newsletter in the article": lambda k, story, own: f"<article>{story}<div class='newsletter-signup'><h4>{own}</h4></div></article>",
    "a sidebar beside the text": lambda k, story, own: f"<div class=cols><div class=text>{story}</div><div class='sidebar'><p>{own}</p></div></div>",
    "a notice above the text": lambda k, story, own: f"<div class='notice'><p>{own}</p></div><div class=text>{story}</div>",
    "a discussion": lambda k, story, own: f"<div class=text>{story}</div><div class='discussion'>" + "".join(f"<div class=entry><p>{own} {n}</p></div>" for n in range(2 + k % 4)) + "</div>",
    "reader entries without a name": lambda k, story, own: f"<div class=text>{story}</div><div class=q>" + "".join(f"<div class=z><p>{own} {n}</p></div>" for n in range(2 + k % 4)) + "</div>",
}


@pytest.mark.parametrize("slot", SLOTS)
def test_barred_blocks_with_texts_of_their_own(spark, slot):
    """Twelve pages of a host, each with its own text in a block that is no part of the article."""
    own = lambda k: f"Something else that only page {k} says, in words {k * 7} and {k * k} of its own"
    story = lambda k: "".join(f"<p>Story {k} goes on with sentence {n}, which has {k * 13 + n} words more or less.</p>" for n in range(5 + k % 3))
    rows = [(k, f"http://slots.example/{k}", f"<html><body><h1>Story {k}</h1>{SLOTS[slot](k, story(k), own(k))}<footer>All rights reserved</footer></body></html>") for k in range(12)]
    found = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for r in found.select("carried.page_id", "main_text").collect():
        k, blocks = r["page_id"], r["main_text"].split("\n\n")
        assert not any(own(k) in b for b in blocks)
        assert blocks == [b for b in ([f"Story {k}"] if blocks[0] == f"Story {k}" else [])] + [f"Story {k} goes on with sentence {n}, which has {k * 13 + n} words more or less." for n in range(5 + k % 3)]


def test_a_page_with_a_menu_only_has_no_text():
    assert html.main_text(html.Page("<html><body><nav><ul><li>Home<li>About</ul></nav></body></html>", "h").pack(), {})[0] == ""


CHINESE = "中文字符串没有空格所以整句是一个很长的单位" * 2


@pytest.mark.parametrize("word", [CHINESE.encode(), b"http" + b"information" * 12, "naïve".encode() * 20])
def test_long_words_are_summed_whole(word, monkeypatch):
    """Forward sums, expected counts and stretches of a long word against plain sums over all its segmentations."""
    from lodestrata.llm import trie as tries

    path = public_tokenizers.path(langid.VOCABULARY)
    pieces = langid.sentence_pieces(path)
    known = {p: k for k, p in enumerate(pieces) if p}
    p = np.repeat(langid.start(path), 2, axis=0)
    p[1] = p[0] ** 0.5 / (p[0] ** 0.5).sum()
    text, longest = b" " + word, max(map(len, pieces))
    n = len(text)

    def sums(text, of):
        """Scaled by 30 a byte, to stay in range."""
        out = [1.0]
        for j in range(1, len(text) + 1):
            total = langid.FALLBACK * 30.0 * out[j - 1]
            for i in range(max(0, j - longest), j):
                k = known.get(text[i:j] if of > 0 else text[i:j][::-1])
                total += 0.0 if k is None else p[abs(of) - 1, k] * 30.0 ** (j - i) * out[i]
            out.append(total)
        return out

    data = np.frombuffer(word, np.uint8)
    start, end = np.array([0]), np.array([len(word)])
    ahead, back = sums(text, 1), sums(text[::-1], -1)[::-1]
    want = np.zeros(len(pieces))
    for i in range(n):
        for j in range(i + 1, min(n, i + longest) + 1):
            k = known.get(text[i:j])
            if k is not None:
                want[k] += 3 * ahead[i] * back[j] / ahead[n] * p[0, k] * 30.0 ** (j - i)
    for stretch in (tries.STRETCH, 29):
        monkeypatch.setattr(tries, "STRETCH", stretch)
        found = langid.word_scores(path, data, start, end, p)[0]
        assert found == pytest.approx([math.log(sums(text, m)[n]) - n * math.log(30.0) for m in (1, 2)])
        assert langid.expected_counts(path, data, start, end, np.array([3]), p[0]) == pytest.approx(want, abs=1e-9)


def test_long_units_are_sampled_whole(monkeypatch):
    """The long lattice has the sums and draws of the other one, and pieces go over what was a cut."""
    v = sampling.vocabulary(public_tokenizers.path(sampling.VOCABULARY), 0.25)
    word = np.frombuffer(b" the", np.uint8)
    short, long_ = sampling.Lattice(v, word[None, :]), sampling.LongLattice(v, word)
    assert long_.sums == pytest.approx(np.log(short.sums[:, 0]))
    seeds = np.arange(3000, dtype=np.uint64) * np.uint64(977)
    a, b = short.draw(np.zeros(3000, int), seeds), long_.draw(np.zeros(3000, int), seeds)
    assert (a[0] == b[0]).all() and a[1] == pytest.approx(b[1])
    for excluded in ([a[0][0]], [a[0][0], sampling.Others(short, 0, [a[0][0]]).draw(np.uint64(5))[0]]):
        for seed in range(50):
            x, y = (sampling.Others(z, 0, excluded).draw(np.uint64(seed)) for z in (short, long_))
            assert (x[0] == y[0]).all() and x[1] == pytest.approx(y[1])
    text = b"information" * 9
    block = sampling.Block(sampling.vocabulary(public_tokenizers.path(sampling.VOCABULARY), 1.0), np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.array([1]))
    ids = next(iter(block.samples(2)))[3]
    ends = np.cumsum([len(block_piece) for block_piece in (v.bytes[k] for k in ids)])
    assert len(block.row) == 1 and ends[-1] == len(text) + 1 and 48 not in ends
