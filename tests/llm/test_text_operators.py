import gzip
import hashlib
import math
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from lattica.llm import chat_format, decontaminate, gif_media, license_scan, lm_scoring, sentencepieces, toxicity, url_filter, warc
from lattica.llm.queries import PIECES_FILE
from lattica.llm.text import Words, pieces

EDGE_DOCS = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "one two"), (5, "ünder Ärger x" * 3000)]


def docs_of(spark, rows):
    """With extra columns whose names clash with those that operators make."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.withColumns({"score": F.lit(1), "fp": F.lit("x"), "id": F.lit(2), "hash": F.lit(3), "lang": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["Foo,", "baß", "x.y"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " tail") for i in range(40)] + [(300, rows[0][1])]
    return rows


def test_words_splits_on_ascii_white_space_only():
    got = Words(pa.array(["A b\x0bC", "", "  ", None or "", "x\u00a0Y\x1cz É"]))
    assert [[got.vocab[i] for i in got.ids[a:b]] for a, b in zip(got.offsets[:-1], got.offsets[1:])] == [[b"a", b"b", b"c"], [], [], [], ["x\u00a0y\x1cz".encode(), "É".encode()]]
    batch = pa.record_batch({"text": pa.array(["a" * 5, None, "b" * 50, "c"])})
    assert [p.num_rows for p in pieces([batch], limit=10)] == [2, 1, 1]


@pytest.mark.parametrize("top_words,filter_bytes", [(1 << 20, 1 << 28), (5, 256)])
def test_lm_scores(spark, corpus, top_words, filter_bytes):
    rows = corpus + EDGE_DOCS
    params = lm_scoring.Params(top_words=top_words, max_filter_bytes=filter_bytes)
    got = lm_scoring.score_split(docs_of(spark, rows), params).collect()
    tokens = [((r[1] or "").encode().lower().split() + [b" end"], zlib.crc32((str(r[0]) if r[0] is not None else "").encode()) % 7 == 2, r[0]) for r in rows]
    counts = Counter(w for t, held, _ in tokens if not held for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for t, held, i in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_lm_score_has_exact_counts_of_all_words(spark, corpus):
    rows = corpus + EDGE_DOCS + [(1000 + i, f"once{i} never{i} w1 once{i}") for i in range(30)]
    rows = [(i, t) for i, t in rows if i is not None]
    whole, few, none = (
        {(r.doc_id, r.n_tokens, r.n_known): round(r.score, 8) for r in lm_scoring.score_split(docs_of(spark, rows), lm_scoring.Params(top_words=top, max_filter_bytes=size)).collect()}
        for top, size in ((1 << 20, 1 << 28), (5, 256), (0, 1 << 28))
    )
    assert whole == few == none


@pytest.mark.parametrize("top_words,filter_bytes", [(1 << 20, 1 << 28), (3, 2048)])
def test_lm_score_equals_brute_force(spark, corpus, top_words, filter_bytes):
    """With a filter wide enough to have no false positives: quantised pair counts, exact word counts, one Dirichlet prior."""
    rows = corpus + EDGE_DOCS + [(500 + i, "w1 w2 " * i + f"rare{i}") for i in range(20)]
    p = lm_scoring.Params(top_words=top_words, max_filter_bytes=filter_bytes, bits_per_entry=60.0, probes=20)
    got = sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in lm_scoring.score_split(docs_of(spark, rows), p).collect())
    texts = [((t or "").encode().lower().split() + [b" end"], zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2, i) for i, t in rows]
    words, pairs = Counter(), Counter()
    for own, held, _ in texts:
        if not held:
            words.update(own)
            pairs.update(zip([b" begin", *own], own))
    n, v = sum(words.values()), len(words)
    want = []
    for own, _, i in texts:
        total = 0.0
        for h, w in zip([b" end", *own], own):
            pair = pairs[(b" begin" if h == b" end" else h, w)]
            low = 2 ** int(math.log2(pair)) if pair else 0
            seen = min((low + 2 * low - 1) / 2 if pair else 0, words[h])
            total += math.log10((seen + p.mu * (words[w] + 1) / (n + v + 1)) / (words[h] + p.mu))
        want.append((str(i), len(own), round(total, 6)))
    assert got == sorted(want)


def test_lm_filter_gives_exact_levels_but_for_false_positives():
    p = lm_scoring.Params()
    keys = lm_scoring.mix(np.arange(5000, dtype=np.uint64))
    counts = np.random.default_rng(1).integers(1, 200, 5000)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    bits, size = lm_scoring.build_segment(keys, counts, p)
    own = lm_scoring.Filter(np.frombuffer(bits, np.uint8), np.array([size]), 0, 63, p)
    own.shift, own.segment = 63, lambda k: np.zeros(len(k), np.int64)
    got, want = own.levels(keys), lm_scoring.level_of(counts, p.base)
    assert (got >= want).all() and (got == want).mean() > 0.97
    assert (own.levels(lm_scoring.mix(np.arange(10**6, 10**6 + 5000, dtype=np.uint64))) == 0).mean() > 0.97
    assert lm_scoring.level_of(np.array([1, 2, 3, 4, 8]), 2.0).tolist() == [1, 2, 2, 3, 4]


@pytest.fixture(scope="module")
def own_pieces():
    return sentencepieces.Pieces(open(PIECES_FILE, "rb").read())


ODD_TEXTS = ("", " ", "a  b ", "☃\n\n\t日本", "x" * 3000, "thenddd rering " * 40, " lead", "a\n b\tc", "ünder Ärger", "日本語 ☃ mixed")


def test_pieces_equal_the_library_and_round_trip(spark, own_pieces):
    """A unigram file is read as the library reads it; a BPE file gets scores by rank first."""
    sentencepiece = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(PIECES_FILE, "rb") as f:
        model.ParseFromString(f.read())
    for p, (_, score, _) in zip(model.pieces, own_pieces.pieces):
        p.score = score
    model.trainer_spec.model_type = 1
    data = model.SerializeToString()
    unigram, theirs = sentencepieces.Pieces(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in ("the rendering of many words", "Über  two spaces", "thntnd eringshe ouen", *ODD_TEXTS[1:]):
        assert own_pieces.encode(text) == unigram.encode(text) == theirs.encode(text), text
    for text in ODD_TEXTS:
        ids, norm = own_pieces.encode(text), own_pieces.normalise(text)
        assert own_pieces.decode(ids) == text
        for size in (1, 5, 1000):
            assert [i for part in own_pieces.stream([norm[k : k + size] for k in range(0, len(norm), size)]) for i in part] == ids
    rows = [*EDGE_DOCS, *enumerate(ODD_TEXTS, 100), *enumerate(ODD_TEXTS, 100)]
    coded = sentencepieces.encode(docs_of(spark, rows), PIECES_FILE)
    assert {r.doc_id: r.ids for r in coded.collect() if r.doc_id and r.doc_id >= 100} == {i: own_pieces.encode(t) for i, t in enumerate(ODD_TEXTS, 100)}
    back = sorted(map(str, (r.text for r in sentencepieces.decode(coded, PIECES_FILE).collect())))
    assert back == sorted(str(t or "") for _, t in rows)
    assert sentencepieces.encode(docs_of(spark, rows).limit(0), PIECES_FILE).count() == 0


def test_streaming_viterbi_is_optimal_by_brute_force(own_pieces):
    scores = {p: score for p, score, kind in own_pieces.pieces if kind in (1, 4)}

    def best(s):
        table = [0.0] + [-math.inf] * len(s)
        for j in range(1, len(s) + 1):
            table[j] = max(table[i] + scores.get(s[i:j], -math.inf) for i in range(max(0, j - own_pieces.longest), j))
        return table[-1]

    rng = np.random.default_rng(8)
    made = ["".join(rng.choice(list("▁thernodig"), 300)) for _ in range(20)]
    for s in ("▁retitioning", "▁thorreou", "▁ndernt▁the", *made):
        for size in (1, 7, 100):
            search = sentencepieces.Search(own_pieces)
            ids = [i for k in range(0, len(s), size) for i in search.push(s[k : k + size])] + search.finish()
            assert sum(own_pieces.pieces[i][1] for i in ids) == best(s)
            assert "".join(own_pieces.pieces[i][0] for i in ids) == s


def test_search_window_is_bounded_and_commits_early(own_pieces):
    """A megabyte without a space, where nothing else ends a part."""
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("etaoinshrdlu"), 1 << 20))
    search, first, widest, n = sentencepieces.Search(own_pieces), None, 0, 0
    for at in range(0, len(text), 1000):
        got = search.push(text[at : at + 1000])
        n += len(got)
        first = at if got and first is None else first
        widest = max(widest, len(search.text))
    assert first < 2000 and widest < 2 * (sentencepieces.CHECK + own_pieces.longest) + 64 and len(search.text) < 500
    n += len(search.finish())
    assert n == len(list(own_pieces.unit(text))) and own_pieces.kept_bytes <= sentencepieces.KEPT_BYTES


def test_pieces_kept_stay_within_their_bytes(own_pieces, monkeypatch):
    monkeypatch.setattr(sentencepieces, "KEPT_BYTES", 20_000)
    words = [f"word{i}tail" for i in range(500)]
    ids = [own_pieces.encode(w) for w in words]
    assert own_pieces.kept_bytes <= 20_000 and [own_pieces.encode(w) for w in words] == ids


def test_pieces_make_about_as_many_ids_as_the_library_merges():
    sentencepiece = pytest.importorskip("sentencepiece")
    theirs = sentencepiece.SentencePieceProcessor(model_file=PIECES_FILE)
    own = sentencepieces.Pieces(open(PIECES_FILE, "rb").read())
    texts = ["International organisations and their representatives were meeting to discuss environmental regulation.", "Le chat dort sur la chaise pendant que la pluie tombe doucement.", "def main(args): return [x for x in args if x is not None]"] * 3
    assert sum(len(own.encode(t)) for t in texts) <= 1.05 * sum(len(theirs.encode(t)) for t in texts)


def brute_reputation(hosts, p, suffixes):
    """Of hosts {host: (n, bad)}: {host: (mean, lower bound, blocked)} by the formulas alone."""

    def place(host):
        bare = host.split("@")[-1]
        bare = bare if bare.startswith("[") and bare.endswith("]") else re.sub(r":[^\]:]*$", "", bare)
        bare = bare.rstrip(".")
        labels = bare.split(".")
        if bare.startswith("[") or (len(labels) == 4 and all(x.isdigit() for x in labels)):
            return bare, bare
        k = next((k for k in range(len(labels), 1, -1) if ".".join(labels[-k:]) in suffixes), 1)
        return ".".join(labels[-k - 1 :]), ".".join(labels[-k:])

    def total(keys):
        out = {}
        for key, (n, bad) in keys:
            a, b = out.get(key, (0, 0))
            out[key] = (a + n, b + bad)
        return out

    def strength(groups, mu):
        own = [(n, bad, mu[k]) for k, (n, bad) in groups.items() if n]
        below = sum((n - 1) * m * (1 - m) for n, _, m in own)
        if not below:
            return p.most_strength
        rho = (sum((bad - n * m) ** 2 / n for n, bad, m in own) - sum(m * (1 - m) for _, _, m in own)) / below
        return min(p.most_strength, max(p.least_strength, 1 / rho - 1)) if rho > 0 else p.most_strength

    domains = total((place(h), x) for h, x in hosts.items())
    tops = total((d[1], x) for d, x in domains.items())
    overall = (sum(b for _, b in tops.values()) + 1) / (sum(n for n, _ in tops.values()) + 2)
    mu = {s: overall for s in tops}
    m = strength(tops, mu)
    means = {s: (b + m * mu[s]) / (n + m) for s, (n, b) in tops.items()}
    mu = {d: means[d[1]] for d in domains}
    m = strength(domains, mu)
    means = {d: (b + m * mu[d]) / (n + m) for d, (n, b) in domains.items()}
    mu = {h: means[place(h)] for h in hosts}
    m = strength(hosts, mu)
    out = {}
    for h, (n, bad) in hosts.items():
        a, b = bad + m * mu[h], n - bad + m * (1 - mu[h])
        mean = a / (a + b)
        bound = mean - p.z * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        out[h] = (mean, bound, bound > min(p.limit, p.lift * overall))
    return out


def test_host_reputation_equals_brute_force(spark):
    """Hosts of mixed outcomes, with ports, users, addresses and long suffixes."""
    rng = np.random.default_rng(6)
    hosts = [f"{a}{d}.{s}{tail}" for d in ("one", "two", "three") for s in ("com", "co.uk", "net", "k12.ca.us") for a in ("", "www.", "x.y.") for tail in ("", ":8080", ".")]
    hosts += ["10.0.0.1", "10.0.0.1:80", "10.0.0.2", "[::1]", "[::1]:443", "user@one.com", "com", "", "localhost"]
    rates, rows = rng.beta(1, 4, len(hosts)), []
    for i, h in enumerate(hosts):
        rows += [(100 * i + j, f"http://{h.upper()}/p{j}", bool(rng.random() < rates[i]) if j % 3 else None) for j in range(rng.integers(1, 40))]
    suffixes = (*url_filter.SUFFIXES, "k12.ca.us")
    pages = spark.createDataFrame([r[:2] for r in rows] * 2, "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "page_id long, bad boolean")
    told: dict[str, tuple[int, int]] = {}
    for i, url, bad in rows * 2:
        host = url[7:].split("/")[0].lower()
        n, b = told.get(host, (0, 0))
        told[host] = (n + (bad is not None), b + bool(bad))
    want = brute_reputation(told, url_filter.Params(), set(suffixes))
    got = url_filter.judge(pages, labels, rules=(), suffixes=suffixes).collect()
    assert len(got) == 2 * len(rows) and {r.host for r in got} == set(told)
    for r in got:
        mean, bound, blocked = want[r.host]
        assert abs(r.bad_rate - mean) < 1e-9 and abs(r.lower_bound - bound) < 1e-9 and r.rule is None
        assert r.verdict == ("block" if blocked else "allow")
    assert len({r.verdict for r in got}) == 2


def test_rules_of_equal_length_go_by_host_then_name(spark):
    rules = (("block", "b.com", "/x/"), ("allow", "com", "/x/yy"), ("block", "a.b.com", "/x"), ("allow", "b.com", "/x/"))
    pages = spark.createDataFrame([(1, "x://a.b.com/x/yy"), (2, "x://c.b.com/x/z"), (3, "x://zb.com/x/z"), (4, "x://b.com")], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, labels, rules).collect()}
    assert got == {1: ("a.b.com/x", "block"), 2: ("b.com/x/", "block"), 3: (None, "allow"), 4: (None, "allow")}


def test_host_reputation(spark):
    rows = [(i, f"http://a{i % 3}.bad.test/x") for i in range(60)] + [(100 + i, f"https://Good.Ok.TEST/p?q#{i}") for i in range(60)] + [(500, None), (501, "no scheme"), (502, "x://h.net/de/81?a"), (503, "x://sub.example.com/en/7"), (504, "http://once.new.test/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"n": F.lit(1), "bad": F.lit(1), "host": F.lit("x"), "pages": F.lit(3)})
    labels = spark.createDataFrame([(i, i < 100) for i, _ in rows[:120]] + [(500, None)], "page_id long, bad boolean")
    got = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    assert len(got) == len(rows)
    assert {got[i].verdict for i in range(60)} == {"block"} and {got[i].verdict for i in range(100, 160)} == {"allow"}
    assert (got[100].host, got[100].path) == ("good.ok.test", "/p") and (got[500].host, got[501].path) == ("", "")
    assert (got[502].rule, got[502].verdict) == ("net/de/", "allow") and (got[503].rule, got[503].verdict) == ("example.com/en/7", "allow")
    assert got[504].lower_bound < got[504].bad_rate < got[0].bad_rate
    assert url_filter.judge(pages.limit(0), labels).count() == 0 and url_filter.judge(pages, labels.limit(0)).count() == len(rows)


def test_leaks(spark):
    item = "If Anna has 12 apples and gives 3 apples to Bob, how many apples does Anna have left today?"
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string").withColumn("win", F.lit(1))
    filler = "quite unrelated words follow here in this text. " * 5
    texts = [(1, filler + item + filler), (2, item.replace("Anna", "Carla").replace("12", "99")), (3, "If Carla has 99 apples and gives 17 apples to Dave, how many apples does Eve have left today?"), (4, filler)]
    docs = docs_of(spark, texts + EDGE_DOCS[:3])
    assert sorted(r.doc_id for r in decontaminate.leaks(docs, bench).collect()) == [1, 2]
    kept = decontaminate.keep_clean(docs, bench)
    # rows that share an id are judged apart, so the empty rows of ids 1 and 2 stay
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 2, 3, 3, 4]
    lost = spark.createDataFrame([(None, item), (None, filler), (None, None), (5, item), (5, item)], "doc_id long, text string")
    assert sorted(str(r.text) for r in decontaminate.keep_clean(lost, bench).collect()) == sorted([filler, "None"])
    assert decontaminate.keep_clean(docs.limit(0), bench).count() == 0
    assert kept.columns == docs.columns and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def brute_template(text):
    """Of plain texts: numbers in digits, names with a capital, units behind numbers, all else in lower case."""
    out, after = [], False
    for raw in text.split():
        word = raw.strip(".,?")
        number = word.isdigit()
        kind = "number" if number else "unit" if after and word in ("km", "kg") else "name" if word[0].isupper() else None
        out.append((f"<{kind}>" if kind else word, (kind, word) if kind else None))
        after = number
    return out


def brute_leaks(texts, items, width=5, least=0.8):
    found = set()
    spans = lambda own: [own[k : k + width] for k in range(len(own) - width + 1)] if len(own) >= width else [own] if own else []
    for i, item in items:
        theirs = spans(brute_template(item))
        shapes = {tuple(w for w, _ in span) for span in theirs}
        for d, text in texts:
            seen, there, back = Counter(), {}, {}
            mine = spans(brute_template(text))
            for span in mine:
                seen[tuple(w for w, _ in span)] += 1
            matched = shapes & set(seen)
            if len(matched) < least * len(shapes):
                continue
            copies = max(seen[x] for x in matched)
            for a in theirs:
                for b in mine:
                    if tuple(w for w, _ in a) == tuple(w for w, _ in b):
                        for (_, x), (_, y) in zip(a, b):
                            if x:
                                there.setdefault(x, set()).add(y)
                                if x[0] == "name":
                                    back.setdefault(y, set()).add(x)
            share = lambda m: sum(len(v) <= copies for v in m.values()) / len(m) if m else 1.0
            if min(share(there), share(back)) >= least:
                found.add((d, i))
    return found


def test_leaks_equal_brute_force(spark):
    """Re-parameterised questions in texts, some with slots that don't agree, some cut short, one window in all of them."""
    rng = np.random.default_rng(11)
    names, things, verbs = ["Anna", "Bob", "Carla", "Dave", "Emil"], [f"thing{k}" for k in range(9)], [f"verb{k}" for k in range(9)]
    pick = lambda x: str(rng.choice(x))
    common = "it is said that {a} and {b} have {n} km {m} kg in all "

    def item():
        body = " ".join(f"then {{{pick(list('ab'))}}} {pick(verbs)} {{{pick(list('nm'))}}} {pick(['km', 'kg', pick(things)])} of the {pick(things)}" for _ in range(rng.integers(1, 4)))
        return (common if rng.random() < 0.7 else "now ") + body + " so how many are left"

    def fill(shape, same=False):
        two = rng.choice(names, 2, replace=False)
        return shape.format(a=two[0], b=two[0] if same else two[1], n=rng.integers(2, 60), m=rng.integers(60, 99))

    shapes = [item() for _ in range(12)]
    items = [(i, fill(x)) for i, x in enumerate(shapes)]
    noise = lambda: " ".join(f"plain{k}" for k in rng.integers(0, 500, 30))
    texts = [(k, " ".join([noise(), fill(shapes[k % 12], k % 5 == 4), *([fill(shapes[(k + 1) % 12])] * (k % 3)), noise()])) for k in range(60)]
    texts += [(100 + k, noise() + " " + " ".join(items[k][1].split()[: 4 + 3 * k])) for k in range(12)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(texts, items)
    assert got == want and len(want) > 60
    planted = {(k, k % 12) for k in range(60) if k % 5 != 4}
    assert len(planted & got) >= 0.95 * len(planted)


def test_short_items_are_found_inside_texts(spark):
    bench = spark.createDataFrame([(1, "purple elephants dance"), (2, "yes"), (3, "12 km 13 km"), (4, "purple elephants dance")], "item_id long, text string")
    texts = [(1, "we say purple elephants dance at night, all of them"), (2, "Purple elephants dance!"), (3, "yes we do say yes"), (4, "yes"), (5, "from 12 km to 14 km 15 km"), (6, "elephants dance")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs_of(spark, texts), bench).collect()}
    assert {g for g in got if g[1] != 3} == {(1, 1), (2, 1), (1, 4), (2, 4), (4, 2)} and (5, 3) not in got


def test_leaks_find_names_at_sentence_starts_and_in_any_case(spark):
    tom, bea = "Tom has 3 apples. Tom buys 5 more. How many apples does Tom have?", "Beatrix walked 7 miles to the shop. How far is the shop from her old house?"
    bench = spark.createDataFrame([(1, tom), (2, bea)], "item_id long, text string")
    texts = [
        (1, "And so, " + tom.replace("Tom", "Anna") + " Nobody knows."), (2, tom.lower()), (3, tom.upper()), (4, tom.lower().replace("tom", "anna").replace("3", "8")), (5, tom),
        (6, bea.replace("Beatrix", "Carl").replace("7", "9")), (7, bea.upper()), (8, bea.lower()), (9, "Tom bought some apples. How many did he have? Nobody knows how many apples Tom has."), (10, "SOME OTHER WORDS OF A TEXT IN CAPITALS. HOW MANY? " * 3),
    ]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs_of(spark, texts), bench).collect()}
    assert got == {*((i, 1) for i in range(1, 6)), *((i, 2) for i in range(6, 9))}


def test_gif_decoder():
    gif, samples = gif_media, bytes(range(256)) * 40 + b"a" * 9000
    coded = gif.lzw_encode(samples)
    assert gif.lzw_decode(coded, 8, len(samples)) == samples
    frames = list(gif.decode_gif(gif.encode_gif(bytes(64 * 2500), rows=1000)))
    assert [(f.start_cs, f.height) for f in frames] == [(0, 1000), (10, 1000), (20, 500)]
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])

    def frame(samples, at, disposal, clear=None, size=(2, 2), flags=0):
        x, y = at
        control = disposal << 2 | (clear is not None)
        head = b"\x21\xf9\x04" + bytes([control, 5, 0, clear or 0, 0]) + b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, *size)) + bytes([flags])
        return head + b"\x02" + gif._as_blocks(gif.lzw_encode(bytes(samples), 2))

    data = b"GIF89a" + b"\x03\x00\x03\x00" + bytes([0x81, 0, 0]) + palette
    data += frame([1, 1, 1, 1], (0, 0), 1) + frame([2, 0, 0, 2], (1, 1), 3, clear=0) + frame([3, 3, 3, 3], (1, 1), 2) + frame([1], (0, 0), 0, size=(1, 1)) + b"\x3b"
    shown = [f.rgba for f in gif.decode_gif(data)]
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert shown[1][1, 1].tolist() == green and shown[1][1, 2].tolist() == [0, 0, 0, 0] and shown[1][0, 1].tolist() == red
    assert shown[2][1, 1].tolist() == blue and shown[2][0, 0].tolist() == red  # the second frame is taken back
    assert shown[3][1, 1].tolist() == [0, 0, 0, 0] and shown[3][2, 2].tolist() == [0, 0, 0, 0]  # cleared after the third
    rows = list(gif.decode_gif(b"GIF87a" + b"\x01\x00\x08\x00" + bytes([0x81, 0, 0]) + palette + frame([0, 1, 2, 3, 1, 1, 1, 2], (0, 0), 0, size=(1, 8), flags=0x40) + b"\x3b"))[0]
    assert [r[0] for r in rows.rgba[:, 0].tolist()][0] == 0 and rows.rgba[4, 0].tolist() == red and rows.rgba[2, 0].tolist() == green and rows.rgba[7, 0].tolist() == green
    with pytest.raises(gif.GifError):
        list(gif.decode_gif(b"GIF89a"))


def test_gif_decoder_refuses_hostile_bytes(spark):
    good = gif_media.encode_gif(bytes(64))
    size_at = good.index(b"\x2c" + bytes(4) + b"\x40\x00") + 10
    rows = [(k, good[:size_at] + bytes([k]) + good[size_at + 1 :]) for k in (0, 1, 9, 64, 200, 255)]
    wide = struct.pack("<HHBBB", 65535, 65535, 0xF7, 0, 0)
    rows += [(300, good[:6] + wide + good[13:]), (301, good[:20]), (302, b""), (303, None), (304, good)]
    got = {r.doc_id: r for r in gif_media.frames(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert set(got) == {k for k, v in rows if v is not None}
    assert all((r.error is None) == (k == 304) for k, r in got.items())
    # codes that would make gigabytes
    codes = np.concatenate([[256, 0], np.arange(258, 4096), np.full(200_000, 4095)])
    widths = np.concatenate([[9], gif_media.code_widths(0, len(codes) - 1, 8)])
    bits = np.concatenate([(c >> np.arange(w)) & 1 for c, w in zip(codes, widths)]).astype(np.uint8)
    assert len(gif_media.lzw_decode(np.packbits(bits, bitorder="little").tobytes(), 8, 100)) == 100


def test_gif_storage(spark):
    got = gif_media.store_and_read(docs_of(spark, EDGE_DOCS)).collect()
    for text in {t for _, t in EDGE_DOCS}:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert any((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) for r in got)
    assert len(got) == len(EDGE_DOCS)
    media = spark.createDataFrame([(1, gif_media.encode_gif(bytes(128))), (2, None), (3, b"junk")], "doc_id long, media binary")
    rows = {r.doc_id: r for r in gif_media.frames(media).collect()}
    assert set(rows) == {1, 3} and rows[1].histogram == "0:128" and rows[3].error and rows[3].frame is None


@pytest.mark.parametrize("model_file", [None, PIECES_FILE])
def test_chat_round_trip(spark, model_file):
    odd = "a <|im_end|>\n<\\|im_start|>x [INST] <\\\\/s></s> <<SYS>>"
    rows = [(1, 0, "system", "be brief"), *((1, i, "user" if i % 2 else "assistant", f"turn {i} " * 30) for i in range(1, 12)), (2, 0, "user", None), (2, 1, None, odd), (2, 1, None, odd), (2, None, "assistant", odd), (None, 0, "assistant", "x"), (3, 0, "us\\er\n", "long " * 900), (3, 1, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(9))
    windows = chat_format.format_windows(turns, chat_format.Params(budget=400, history_turns=2, history_tokens=150), model_file)
    got = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        want = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == want
    cut = [r for r in windows.collect() if r.conv_id == 1]
    assert len(cut) > 2 and all(not r.over_budget for r in cut) and all("be brief" in r.text for r in cut)
    assert all(r.n_repeated > 1 for r in cut[1:]) and chat_format.read_back(chat_format.format_windows(turns.limit(0))).count() == 0


def test_chat_windows_equal_brute_force(spark):
    """Turn-aligned spans from prefix sums, and what each window repeats and masks."""
    rng = np.random.default_rng(12)
    p, rows = chat_format.Params(budget=60, history_turns=3, history_tokens=25), []
    for conv in range(25):
        for turn in range(rng.integers(1, 14)):
            role = "system" if turn == 0 and conv % 2 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, " ".join(f"t{conv}_{turn}_{k}" for k in range(rng.integers(0, 30 if conv % 7 else 80)))))
    got = {(r.conv_id, r.window): r for r in chat_format.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), p).collect()}
    want = {}
    for conv in range(25):
        turns = [(r, x, chat_format.MARKS + 1 + len(x.split())) for c, _, r, x in rows if c == conv]
        head = turns[:1] if turns[0][0] == "system" else []
        body, start, n = turns[len(head) :], 0, 0
        fixed = sum(t for *_, t in head)
        while start < len(body) or (head and not n):
            room, repeated = min(p.history_tokens, p.budget - fixed - (body[start][2] if start < len(body) else 0)), []
            for old in reversed(body[max(0, start - p.history_turns) : start]):
                if old[2] > room:
                    break
                repeated.insert(0, old)
                room -= old[2]
            used, end = fixed + sum(t for *_, t in repeated), start
            while end < len(body) and (end == start or used + body[end][2] <= p.budget):
                used += body[end][2]
                end += 1
            want[conv, n] = ((head if n else []) + repeated, (head if not n else []) + body[start:end], used)
            start, n = end, n + 1
    assert set(got) == set(want) and max(n for _, n in want) > 3
    for key, (again, fresh, used) in want.items():
        r = got[key]
        assert r.text == "".join(f"<|im_start|>{a}\n{x}<|im_end|>\n" for a, x, _ in again + fresh)
        assert (r.n_repeated, r.n_tokens, r.over_budget) == (len(again), used, used > p.budget)
        assert [r.text[s.start : s.end] for s in r.loss_spans] == [x for a, x, _ in fresh if a == "assistant"]


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    plain, foul = [f"word{i}" for i in range(300)], ["vilething", "awfulthing", "nastything"]
    rows, grades = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = list(rng.choice(plain, 40)) + (list(rng.choice(foul, rng.integers(1, 6))) if bad else [])
        rows.append((i, " ".join(rng.permutation(words))))
        grades.append((i, int(bad)))
    docs, told = docs_of(spark, rows + [(None, None), (900, "")]), spark.createDataFrame([*grades[:300], (1, None), (None, 1)], "doc_id long, grade int")
    model = toxicity.train(docs, told)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [got[i].toxic == (i % 4 == 0) for i in range(300, 400)]
    assert sum(held) >= 95 and not got[900].toxic and not got[None].toxic
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    assert toxicity.keep_clean(docs, model).count() == sum(not r.toxic for r in got.values())
    assert not any(r.toxic for r in toxicity.score(docs, toxicity.train(docs, told.limit(0))).collect())


def test_ordinal_fit_orders_severity():
    rng = np.random.default_rng(4)
    hits = rng.integers(0, 6, 600)
    grades = np.clip((hits + rng.normal(0, 0.3, 600)) // 2, 0, 2).astype(int)
    rows = np.concatenate([np.full(h, i) for i, h in enumerate(hits)]).astype(int)
    cols = np.concatenate([rng.permutation(6)[:h] for h in hits]).astype(int)
    weights, thresholds = toxicity.fit(rows, cols, grades, 6, toxicity.Params())
    tail = toxicity.at_least(np.array([weights[:h].sum() for h in range(6)]), thresholds)
    assert (np.diff(tail.sum(axis=1)) > 0).all() and tail[5].sum() > 1.5 and tail[0].sum() < 0.2


def test_warc_derivatives(spark):
    page = "<html><head><title>A &amp; b</title><style>p{}</style></head><body><!-- x --><p>One<b>two</b></p><script>no()</script><a href='/c?d'>link</a></body></html>"
    rows = [(1, "http://h.test/a", page), (2, None, None), (None, "http://x", "plain < text")]
    records = warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(0)))
    extra = spark.createDataFrame([(8, None), (9, b"junk")], "page_id long, record binary")
    got = warc.derivatives(records.unionByName(extra)).collect()
    sources = {r.page_id: warc.read_record(bytes(r.record)) for r in records.collect()}
    assert len(got) == 7 and [r.error for r in got if r.page_id == 9] == ["no WARC record"]
    for r in (r for r in got if r.page_id in (1, 2)):
        head, block = warc.read_record(bytes(r.record))
        own, src = dict(head), dict(sources[r.page_id][0])
        assert own["WARC-Refers-To"] == src["WARC-Record-ID"] == r.refers_to and own["WARC-Type"] == r.record_type
        assert own.get("WARC-Target-URI") == src.get("WARC-Target-URI") and own["WARC-Block-Digest"] == warc.digest(block)
        assert r.source_payload_digest == src["WARC-Payload-Digest"] and r.payload_intact
    text = next(warc.read_record(bytes(r.record))[1].decode() for r in got if r.page_id == 1 and r.record_type == "conversion")
    meta = next(warc.read_record(bytes(r.record))[1].decode() for r in got if r.page_id == 1 and r.record_type == "metadata")
    assert text == "A & b\nOnetwo\nlink" and "outlink: http://h.test/c?d\r\n" in meta and "title: A & b\r\n" in meta


def stored(head, body, kind="text/html"):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: " + kind.encode() + b"\r\n" + head + b"\r\n" + body
    return warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", "http://h.test/a")], block)


def test_warc_bodies_are_read_through_their_codings():
    page = "<title>T é</title><p>Hello <a href=b>x</a>".encode()
    chunked = b"".join(b"%x;ext=1\r\n%s\r\n" % (len(page[i : i + 7]), page[i : i + 7]) for i in range(0, len(page), 7)) + b"0\r\n\r\n"
    squeezed = zlib.compressobj(wbits=-15)
    raw = squeezed.compress(page) + squeezed.flush()
    cases = [(b"", page), (b"Transfer-Encoding: chunked\r\n", chunked), (b"Content-Encoding: gzip\r\n", gzip.compress(page)), (b"Content-Encoding: gzip\r\n", gzip.compress(page[:9]) + gzip.compress(page[9:])), (b"Content-Encoding: deflate\r\n", zlib.compress(page)), (b"Content-Encoding: deflate\r\n", raw), (b"Content-Encoding: zstd\r\n", zstandard.compress(page)), (b"Content-Encoding: gzip, deflate\r\n", zlib.compress(gzip.compress(page)))]
    for head, body in cases:
        meta, text = warc.derive(stored(head, body))
        assert warc.read_record(text["record"])[1].decode() == "T é\nHello x" and meta["n_links"] == 1
        assert b"title: T \xc3\xa9\r\n" in meta["record"] and b"WARC-Refers-To-Target-URI: http://h.test/a\r\nWARC-Refers-To-Date: 2024" in text["record"]
    for head, body in [(b"Transfer-Encoding: chunked\r\n", b"5\r\nhel"), (b"Content-Encoding: gzip\r\n", gzip.compress(page)[:-9]), (b"Content-Encoding: gzip\r\n", b"plain"), (b"Content-Encoding: br\r\n", b"x"), (b"Content-Encoding: gzip\r\n", gzip.compress(bytes(5000)))]:
        with pytest.raises(ValueError):
            warc.derive(stored(head, body), max_body=1000)
    assert [x["error"] for x in warc.derive(stored(b"", page, "text/html; charset=nonsense"))] == [None, None]


def test_page_scan():
    text, title, links = warc.scan("a<b>c</b>d<script>if (a</b>) x</script>e<!-- <p> -->f<TITLE>one &amp; <i>two</i></Title><a data-href=no HREF='/x&amp;y'>l</a><a>1 < 2 &lt;p&gt;<br>z<style>q")
    assert (text, title, links) == ("acd e f\none & two\nl1 < 2 <p>\nz", "one & two", ["/x&y"])
    assert warc.scan("") == ("", "", []) and warc.scan("<p")[0] == "" and warc.scan("İ<script>x</SCRIPT>y")[0] == "İ y"


def test_license_phrases_equal_brute_force():
    rng = np.random.default_rng(3)
    keys = [(b"mit license", "mit"), (b"general public license", "gpl"), (b"a a", "aa")]
    for _ in range(200):
        words = [str(w).encode() for w in rng.choice(["mit", "license", "general", "public", "a", "mitx"], rng.integers(0, 40))]
        want: dict[str, list[int]] = {}
        for phrase, label in keys:
            own = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(own)] == own]
            if found:
                want[label] = found
        assert license_scan.phrase_places(words, keys) == want


def test_long_and_hostile_texts_take_linear_time():
    began = time.time()
    words = license_scan.words_of(b"mit license " * 100_000)
    assert len(license_scan.phrase_places(words, [(b"mit license", "mit")])["mit"]) == 100_000
    index = license_scan.Index(license_scan.TEMPLATES, {}, license_scan.Params())
    index.matches(license_scan.words_of(b"permission the software copyright " * 30_000))
    for page in ("<a ", "<title>", "<script>", "<!--", "<", "<a href=", "</p", "<!", "<a href='", "&", "&#"):
        warc.scan(page * (1_000_000 // len(page)))
        warc.scan("<p>" + page * (1_000_000 // len(page)) + ">")
    assert time.time() - began < 40


@pytest.mark.parametrize("shift", [0, 24, 31, 100])
def test_whole_license_texts_are_found_at_any_place(spark, shift):
    text = next(t for k, t in license_scan.TEMPLATES if k == "bsd" and len(t) > 500)
    rows = [(1, " ".join(f"w{i}" for i in range(shift)) + " " + text.upper() + " after it"), (2, " ".join(text.split()[::3])), (3, text.replace("SOFTWARE", "PROGRAM"))]
    got = {r.doc_id: r for r in license_scan.scan(docs_of(spark, rows)).collect()}
    assert "bsd" in got[1].labels and got[1].score == 1.0 and got[2].labels == "" and "bsd" in got[3].labels


def test_license_scan(spark):
    long = "x " * 100
    rows = [(1, "Released under the MIT-License. mit license mit license"), (2, long + dict(license_scan.TEMPLATES)["bsd"].upper() + " " + long), (3, "apache licenses"), *EDGE_DOCS]
    got = [r for r in license_scan.scan(docs_of(spark, rows)).collect()]
    one, two, three = (next(r for r in got if r.doc_id == i and r.n_words > 1) for i in (1, 2, 3))
    assert (one.n_words, one.n_base, one.first_word, one.last_word, one.base_labels, one.score) == (9, 3, 3, 7, "mit", 1.0)
    assert (two.labels, two.base_labels, two.n_base) == ("bsd", "", 0) and two.score == 1.0
    assert (three.labels, three.score, three.first_word) == ("", 0.0, None) and len(got) == len(rows)


def test_license_join_equals_brute_force():
    rng = np.random.default_rng(6)
    p = license_scan.Params(least_words=4, containment=0.7)
    vocab = [f"t{i}" for i in range(14)]
    templates = [(str(k), " ".join(rng.choice(vocab, rng.integers(3, 20)))) for k in range(8)]
    index = license_scan.Index(templates, {w.encode(): int(rng.integers(0, 9)) for w in vocab}, p)
    n = 0
    for _ in range(80):
        words = [w.encode() for w in rng.choice(vocab + ["z"] * 8, rng.integers(0, 90))]
        want = {}
        for t, (_, text) in enumerate(templates):
            size = next(k for k in (4, 8, 16, 32) if k >= len(text.split()))
            whole = set(text.encode().split())
            for b in range(max(0, math.ceil((len(words) - 2 * size) / (size // 2))) + 1):
                own = set(words[b * size // 2 : b * size // 2 + 2 * size])
                if len(own & whole) >= math.ceil(p.containment * len(whole) - 1e-9):
                    want[size, b, t] = len(own & whole) / len(whole)
        assert index.matches(words) == want
        n += len(want)
    assert n > 50


def test_crc_and_regex_are_what_the_contract_says():
    assert re.findall(rb"[^\x20\x09-\x0D]+", b" a\x0bb ") == [b"a", b"b"]


def test_empty_tables_give_no_rows(spark):
    docs = docs_of(spark, [(1, "a")])
    none = docs.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, grade int")
    model = toxicity.train(none, labels)
    for got in (
        lm_scoring.score_split(none), sentencepieces.encode(none, PIECES_FILE), gif_media.store_and_read(none), toxicity.score(none, model), toxicity.keep_clean(none, model),
        warc.derivatives(warc.responses(pages)), license_scan.scan(none), url_filter.judge(pages, spark.createDataFrame([], "page_id long, bad boolean")),
    ):
        assert got.count() == 0 and len(got.columns) > 1
    assert toxicity.score(docs, model).first().toxic is False  # nothing is toxic without labels


def test_repeated_rows_and_very_long_texts(spark):
    """Each row has its own result, equal texts equal ones."""
    long = "word" + " of a very long text mit license" * 20_000
    rows = [(1, long), (1, long), (2, "short vilething"), (2, "short vilething"), (None, long)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, None)], "doc_id long, grade int")
    model = toxicity.train(docs, labels, toxicity.Params(least_rows=1, least_z=0.1))
    for got in (toxicity.score(docs, model).drop("doc_id"), license_scan.scan(docs).drop("doc_id"), gif_media.store_and_read(docs).drop("doc_id")):
        found = Counter(map(tuple, got.collect()))
        assert sorted(found.values()) == [2, 3]
    assert {r.n_base for r in license_scan.scan(docs).collect()} == {20_000, 0}
    pages = spark.createDataFrame([(1, "http://h.test/", f"<p>{long}"), (1, "http://h.test/", f"<p>{long}"), (2, None, None)], "page_id long, url string, html string")
    derived = warc.derivatives(warc.responses(pages)).collect()
    assert len(derived) == 6 and len({r.record_id for r in derived}) == 4 and all(r.error is None for r in derived)
    assert {r.content_length for r in derived if r.record_type == "conversion" and r.page_id == 1} == {len(long)}


@pytest.mark.parametrize("top_words", [1 << 20, 2])
def test_base_scores_need_no_pairs_and_equal_those_beside_them(spark, monkeypatch, top_words):
    docs = docs_of(spark, [(1, "a b a c"), (2, None), (3, ""), (4, "B b zz a a"), (5, "c c c yy"), (9, "a"), (9, "a")])
    params = lm_scoring.Params(top_words=top_words)
    own = lambda f: sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in f.collect())
    want = own(lm_scoring.score_split(docs, params))

    def none(*args):
        raise AssertionError("a filter of pairs was built")

    monkeypatch.setattr(lm_scoring, "_filter", none)
    assert own(lm_scoring.base_split(docs, params)) == want
    assert lm_scoring.base_split(docs.limit(0)).count() == 0
