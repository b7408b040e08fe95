"""Operators against plain versions of their contracts."""

import collections
import hashlib
import random
import re

import duckdb
import pytest
import tables
from oracle import connect, same

from tidemark.llm import chat, decontam, html_text, mixing, pii, queries, quality_rules, suffix_dedup
from tidemark.llm.minhash import near_duplicates


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    same(connect(sf), queries.ORACLE_SQL[name], queries.QUERIES[name](spark, sf))


def test_sql_of_near_duplicates_splits_at_every_separator(spark, tmp_path):
    rows = [(i, f"a{s}b c d e f g h i j k l m n o p q r s t") for i, s in enumerate(" \t\n\x0b\x0c\r")] + [(9, "a\x1cb c d e f"), (10, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(con, queries.ORACLE_SQL["op4_near_duplicates"], queries.op4_near_duplicates(spark, str(tmp_path)))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_automaton_hits_are_exact():
    rnd = random.Random(1)
    for _ in range(300):
        v, window = rnd.choice([2, 3, 6]), rnd.choice([3, 4, 10])
        items = [(str(k), " ".join(f"w{rnd.randrange(v)}" for _ in range(rnd.randrange(14)))) for k in range(rnd.randrange(1, 6))]
        doc = [f"w{rnd.randrange(v + 1)}" for _ in range(rnd.randrange(40))]
        spans, names = decontam.Automaton(items, window).stream([w.encode() for w in doc])
        hit, found = set(), set()
        for name, text in items:
            ws = text.split()
            k = min(window, len(ws))
            for p in range(len(ws) - k + 1 if k else 0):
                for q in range(len(doc) - k + 1):
                    if doc[q : q + k] == ws[p : p + k]:
                        hit |= set(range(q, q + k))
                        found.add(name)
        assert {i for s, e in spans for i in range(s, e)} == hit and names == found


def test_blocks_of_items_give_the_same_hits(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = (sorted(map(str, decontam.find_hits(docs, items, block_bytes=b).select("doc_id", "hits_").collect())) for b in (10**9, 2_000))
    assert one == many


def test_cutting():
    assert decontam.cut_text("A b, C d. e", [1], [3]) == "A \n d. e"


def test_suffix_array():
    rnd = random.Random(2)
    import numpy as np

    for trial in range(300):
        t = np.array([rnd.randrange(rnd.choice([1, 2, 3, 200])) for _ in range(rnd.randrange(1, 60))], np.int16)
        t = np.repeat(t, rnd.randrange(1, 20)) if trial % 5 == 0 else t
        plain = t.tolist()
        assert suffix_dedup.suffix_array(t, len(t) + 1).tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])


def covered(texts, length):
    """Which bytes lie in strings of this length that also start anywhere else."""
    seen = collections.Counter(d[s : s + length] for d in texts for s in range(len(d) - length + 1))
    out = []
    for d in texts:
        hit = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                hit[s : s + length] = b"\1" * length
        out.append(hit)
    return out


def common_passages(seed=4):
    """Texts around one passage that all share, a shorter one, long runs of one letter, and a text that repeats itself."""
    r = random.Random(seed)
    said = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line, passage, own = said(150), said(300), said(700)
    texts = [said(r.randrange(300)) + r.choice([line, passage, passage[:256], passage[5:]]) + said(r.randrange(300)) for _ in range(60)]
    return [*texts, "x" * 3000, "x" * 2999 + "y", "x" * 401, own + "-" + own, passage, passage[:255]]


@pytest.mark.parametrize("crowded,gram", [(4_000_000, 192), (3_000, 192), (0, 250), (0, 128)])
def test_repeated_passages(spark, sf, monkeypatch, crowded, gram):
    """Also with so low a bound that second names and the plain count take over."""
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    monkeypatch.setattr(suffix_dedup, "LONG_GRAM", gram)
    monkeypatch.setattr(suffix_dedup, "LOT_BYTES", 50_000)
    made = spark.createDataFrame([(1000 + i, t, "en", "a", 1) for i, t in enumerate(common_passages())], tables.DOC)
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(tables.docs(spark)).unionByName(made)
    got = suffix_dedup.remove_repeats(docs).collect()
    data = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    gone, shared = (covered([d for _, d in data], n) for n in (400, 256))
    want = sorted((str(i), hashlib.sha256(bytes(c for c, g in zip(d, gs, strict=True) if not g)).hexdigest(), sum(ss)) for (i, d), gs, ss in zip(data, gone, shared, strict=True))
    assert sorted((str(r.doc_id), hashlib.sha256(bytes(r.kept)).hexdigest(), sum(x.end - x.start for x in r.shared)) for r in got) == want


def families(seed=5, sizes=(40, 90)):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(800)]
    out = []
    for size in sizes:
        base = [r.choice(vocabulary) for _ in range(r.choice([60, 150]))]
        for _ in range(size):
            x = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
                p, op = r.randrange(len(x)), r.random()
                if op < 0.6:
                    x[p] = r.choice(vocabulary)
                elif op < 0.8:
                    del x[p : p + r.randrange(1, 6)]
                else:
                    x[p:p] = [r.choice(vocabulary)]
            out.append(" ".join(x))
    return out


def test_near_duplicate_components(spark):
    texts = [*families(), *(t for _, t, *_ in tables.rows())]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in range(len(sets))}


def test_shared_id_joins_its_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b)], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(docs).collect()} == {1}


def water(sizes, weights, times=3):
    """Targets by resharing the excess until no source is above its cap."""
    total, capped = float(sum(sizes)), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(times * sizes[i] for i in capped)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > times * sizes[i]}
        if not over:
            return [times * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(tables.docs(spark))
    got = mixing.mix(docs).collect()
    size = collections.Counter()
    for r in docs.collect():
        size[r.source] += len(words(r.text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, water([size[s] for s in names], [k % 3 + 1 for k in range(len(names))]), strict=True))
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 24
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_sainte_lague(spark):
    from pyspark.sql import functions as F

    votes = [53, 24, 23, 0, 7]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(votes)], "g string, i long, v long")
    for seats in (0, 1, 7, 40, 1000):
        won = [0] * len(votes)
        for _ in range(seats):
            won[max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
        got = mixing.sainte_lague(df, ["g"], "v", F.lit(seats).cast("long"), "i", "won").orderBy("i").collect()
        assert [r.won for r in got] == won


CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(CONTRACT.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, digits[::-1])))
            if {"email": True, "ip": all(int(p) <= 255 for p in re.findall("[0-9]+", m[0])), "card": 14 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]:
                found.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def test_base_spans():
    rnd = random.Random(4)
    texts = ["a@b@c.com", "..@x.y.", "1.2.3.4.5 300.1.1.1 001.2.3.255", "4111 1111 1111 1111-", "+1 (555) 010-9999 x", "+-1", "a@b.c@d.e"]
    texts += ["".join(rnd.choice("aZ0159@.+- ()é\n") for _ in range(rnd.randrange(80))) for _ in range(4000)]
    for t in texts:
        assert [x for x in pii.listed(pii.find(t)).split(",") if x and x.split(":")[0] in pii.BASE] == base_spans(t)


def test_added_kinds_and_redaction():
    t = "bank DE89370400440532013000, ssn 123-45-6789, mail a.b@c.org"
    assert pii.redact_text(t) == "bank <IBAN>, ssn <SSN>, mail <EMAIL>"
    assert pii.find("number 123-45-6789") == [] and pii.find("DE89370400440532013001") == []


def test_long_runs_are_scanned_once():
    import time

    began = time.time()
    for c in "a1.@+-":
        pii.find(c * 200_000)
    assert time.time() - began < 20


def test_rules_base(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.rate(docs, labels).collect():
        text = texts[r.doc_id]
        ws = words(text)
        lines = [x for x in text.split("\n") if words(x)]
        windows = collections.Counter(zip(ws, ws[1:], ws[2:], strict=False))
        hit = {i + k for i, w in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if windows[w] > 1 for k in range(3)}
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(ws) < 50 or 100 * len(hit) > 50 * len(ws)) and not (r.base_failed and r.kept)


def test_chat_round_trip(spark):
    rnd = random.Random(6)
    pieces = [*chat.marks(chat.TEMPLATE), "\\", "<", "[", "/", "s>", "a", "\n", "SYS>>", "é"]
    said = [(c, t, rnd.choice(["user", "assistant", "system", "b\\<<END>>"]), "".join(rnd.choice(pieces) for _ in range(rnd.randrange(9)))) for c in range(200) for t in range(4)]
    rows = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    for r in chat.digests(chat.format_chats(rows)).collect():
        own = [(role, text) for c, _, role, text in said if c == r.conv_id]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        loss = "".join(b for a, b in own if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_templates_must_not_overlap():
    with pytest.raises(ValueError):
        chat.check_template({"roles": {"user": ("<a>", "<a><b>", False)}, "other": ("1", "2", "3")})


def test_block_labeller_on_unseen_pages():
    model, cells = html_text.trained(), html_text.WordCells()
    right = total = 0
    for page, main in html_text.training_pages(120, seed=99):
        want = "\n".join(b.text for b in html_text.cut(page) if b.text in main)
        right += html_text.extract_pages([page], model, cells) == [want]
        total += 1
    assert right >= 0.97 * total


def test_extracted_pages_are_the_articles(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", p)).split()) for p in re.split(r"</?(?:p|h1)\b[^>]*>", article))
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    langs = [r.lang_pred == docs[r.doc_id] for r in queries.op7_language(spark, sf).where("held_out").collect()]
    assert sum(langs) >= 0.98 * len(langs)
    marks = [r.predicted == quality[r.doc_id] for r in queries.op10_line_crf(spark, sf).where("held_out").collect() if r.doc_id in quality]
    assert sum(marks) >= 0.95 * len(marks)


def firsts_of_groups(texts, percent):
    """The smallest id of every group of linked texts, by comparing all that share a shingle."""
    sets, holders = {}, collections.defaultdict(list)
    for i, text in texts.items():
        ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()
        for x in sets[i]:
            holders[x].append(i)
    first = {i: i for i in texts}
    moved = True
    pairs = {(a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    linked = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in linked:
            low = min(first[a], first[b])
            moved = moved or first[a] != low or first[b] != low
            first[a] = first[b] = low
    return {i for i in texts if first[i] == i}


def test_pipeline_keeps_clean_and_drops_the_rest(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf).collect()}
    good = [i in judged for i, q in quality.items() if q == 1]
    bad = [i in judged for i, q in quality.items() if q == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.15 * len(bad)
    left = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert {r.doc_id for r in left.collect()} == firsts_of_groups({r.doc_id: r.text for r in docs.collect()}, 80)
    cut = corpus_pipeline.decontamination(spark, docs, sf).cache()
    assert decontam.report(cut, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").count() == 0
    assert cut.count() >= 0.97 * docs.count()
    safe = corpus_pipeline.personal_data(spark, docs, sf)
    assert pii.scan(safe).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
