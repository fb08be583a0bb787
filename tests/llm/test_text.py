"""Substring dedup, Jaccard join, language ID, personal data and mixing against brute force."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillscan.llm import jaccard, langid, mixing, pii
from quillscan.llm.substring import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed(rows, width=20):
    seen, out = set(), {}
    for key, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        out[key] = (len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone) if not g).encode()).hexdigest())
    return out


def test_substrings(docs, doc_rows, no_docs):
    want = removed([r[:2] for r in doc_rows])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(docs).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 1000
    assert dedup_substrings(no_docs).count() == 0


def test_substrings_with_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text), (1, text), (None, text), (2, "q " + text)]
    got = sorted((str(r.doc_id), r.n_removed) for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect())
    assert got == [("1", 30), ("1", 30), ("2", 30), ("None", 0)]


def linked(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for key, text in rows:
        words = WORD.findall((text or "").translate(lower))
        sets[key] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_near_duplicates(docs, doc_rows, no_docs):
    want = linked([r[:2] for r in doc_rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == want and sum(k != c for k, (_, c) in want.items()) >= 10
    assert jaccard.near_duplicates(no_docs).count() == 0


def test_near_duplicates_chain_and_null_ids(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(None, " ".join(base))]
    for k in range(12):  # a chain: neighbours link, ends do not
        rows.append((k, " ".join(base[: 200 - 3 * k] + [f"x{j}" for j in range(3 * k)])))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = linked([r for r in rows if r[0] is not None])
    assert {k: v for k, v in got.items() if k is not None} == {k: c for k, (_, c) in want.items()} and got[None] is None


def test_second_round_joins_what_stars_leave_apart(spark, monkeypatch):
    """Near misses of a first member that link with each other, in several comparison cells."""
    monkeypatch.setattr(jaccard, "CELL", 3)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 9):
        own = base[:]
        for j in range(9):
            own[j * 16 + 3] = f"same{j}"
        own[7] = f"x{k}"
        rows.append((k, " ".join(own)))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: c for k, (_, c) in linked(rows).items()}


def test_language_id(docs, doc_rows, no_docs):
    model = langid.train(docs)
    assert model.langs == ["aa", "bb"]
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    known = [r for r in doc_rows if r[0] < 70 and len(r[1]) > 60]
    right = sum(got[r[0]].lang_pred == r[2] for r in known)
    assert right >= 0.97 * len(known)
    assert got[200].lang_pred == got[201].lang_pred == got[213].lang_pred == "und" and got[201].score == 0.0
    assert all(0 <= r.score <= 1 for r in got.values()) and got[0].n_tokens == "clash"
    assert langid.identify(no_docs, langid.train(no_docs)).count() == 0


def test_cross_parsing_equals_the_definition():
    import numpy as np

    samples = {"a": ["banana bandana"], "b": ["cabbage"]}
    model = langid.Model(samples)
    text = "banbage xa na"
    buf = np.frombuffer(text.encode(), np.uint8)
    got = model.phrases(buf, np.asarray([0, len(buf)]))[0][0]
    for k, train in enumerate(("banana bandana", "cabbage")):
        n, at = 0, 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in train:
                size += 1
            n, at = n + 1, at + size
        assert got[k] == n


def test_cross_parsing_over_block_edges():
    """Whole texts of many blocks, some of which repeat the training text, parse as the definition says."""
    import random

    import numpy as np

    rng = random.Random(3)
    train = {k: "".join(rng.choice(letters) for _ in range(900)) for k, letters in (("a", "abc"), ("b", "abcdef"), ("c", "一二三四五"))}
    model = langid.Model({k: [v] for k, v in train.items()})
    texts = [train["a"][100:800] + "x" + train["b"], "".join(rng.choice("abcdefg") for _ in range(2000)), "ab" * 700, train["c"] * 2, "q", "a" * 256, "a" * 257]
    offs = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    got, size, _ = model.phrases(np.frombuffer("".join(texts).encode(), np.uint8), offs)
    assert size.tolist() == [len(t) for t in texts]
    for i, text in enumerate(texts):
        for k, lang in enumerate(model.langs):
            n, at = 0, 0
            while at < len(text):
                size = 1
                while at + size < len(text) and text[at : at + size + 1] in train[lang]:
                    size += 1
                n, at = n + 1, at + size
            assert got[i, k] == n


def test_training_uses_whole_rows_and_the_shortest_where_all_are_long(spark):
    long_ = "lange wörter " * 1000
    rows = [(1, "short words here", "en"), (3, long_, "de"), (5, long_ + long_, "de"), (4, None, "fr"), (7, "x", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"]


def test_base_spans_follow_the_patterns():
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    import random

    rng = random.Random(3)
    parts = ["a", "@", ".", "b.c", "@x.y", "1", "23", "4111 1111 1111 1111", "+", "(", "-", " ", "10.0.0.1", "256.1.1.1", "+1 555 010 9999", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        want = []
        for k, (kind, pattern) in enumerate(kinds.items()):
            for m in re.finditer(pattern, text):
                digits = re.sub(r"[^0-9]", "", m[0])
                ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and pii._luhn(digits.encode()), "phone": 10 <= len(digits) <= 15}[kind]
                if ok:
                    want.append((m.start(), k, m.end()))
        data = text.encode()
        points = [len(data[:i].decode(errors="ignore")) for i in range(len(data) + 1)]
        assert [(points[s], k, points[e]) for s, k, e in pii.base_spans(data)] == sorted(want), text


def test_personal_data(spark, docs, doc_rows, no_docs):
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert len(got) == len(doc_rows)
    assert [got[209].n_email, got[210].n_ip, got[211].n_card, got[212].n_phone] == [1, 2, 1, 1]
    assert got[210].spans.startswith("ip:3:11") and got[200].base_sha256 == hashlib.sha256(b"").hexdigest()
    rows = [(k, f"common words zorblax bob@mail.example.com here {k}") for k in range(3)] + [(10 + k, "common words here") for k in range(200)]
    found = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:13:20" in found[0] and found[10] == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[0] == "common words [TERM] [EMAIL] here 0" and clean[10] == "common words here"
    assert pii.find_personal_data(no_docs).count() == 0


def test_terms_of_the_whole_document_disclose(spark):
    """Names far from the address, account numbers beside it and short words are weighed; digits of entities are not terms."""
    far = " ".join(f"w{k % 5}" for k in range(40))
    rows = [(k, f"Vandermolen {far} kim@a.example.com jdoe42 @kim_v qz") for k in range(2)] + [(k, f"plain {far} 77") for k in range(2, 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find_personal_data(frame).collect()}
    text = rows[0][1]
    at = [(text.index(w), "email" if "." in w else "term", len(w)) for w in ("Vandermolen", "kim@a.example.com", "jdoe42", "kim_v", "qz")]
    assert found[0] == found[1] == ",".join(f"{kind}:{s}:{s + n}" for s, kind, n in sorted(at)) and not any(found[k] for k in range(2, 60))


def test_disclosing_terms_follow_the_definition(spark, monkeypatch):
    """Against brute force over random documents, with counts sent early."""
    import math
    import random
    from itertools import product

    monkeypatch.setattr(pii, "_HELD", 8)
    rng = random.Random(8)
    texts = [" ".join(rng.choice([f"t{rng.randint(0, 120)}", f"a{rng.randint(0, 30)}@b.example.com"]) if rng.random() < 0.4 else f"c{rng.randint(0, 9)}" for _ in range(rng.randint(1, 14))) for _ in range(150)]
    docs = [(set(w for w in t.split() if "@" not in w), set(w for w in t.split() if "@" in w)) for t in texts]
    count = lambda e, t: sum((e is None or e in es) and (t is None or t in ts) for ts, es in docs)
    want = set()
    for e, t in {p for ts, es in docs for p in product(es, ts)}:
        n, share = count(e, t), count(e, t) / count(None, t)
        if n >= pii.SUPPORT and share >= pii.DISCLOSURE and math.log2(share * len(docs) / count(e, None)) >= pii.BITS:
            want.add(t)
    got = set()
    for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got |= {texts[r.doc_id][int(s) : int(e)] for kind, s, e in (x.split(":") for x in r.spans.split(",") if x) if kind == "term"}
    assert got == want and want


def test_mixing(docs, doc_rows, no_docs):
    got = mixing.draw(docs, []).select("_id", "_size", "_target", "_draws").collect()
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in doc_rows}
    assert {r["_id"]: r["_size"] for r in got} == size
    taken = {r["_id"]: sum(d["take"] for d in r["_draws"]) for r in got}
    assert all(taken[k] <= 2 * size[k] for k in size)
    source = {r[0]: r[3] for r in doc_rows}
    sums, target = Counter(), {}
    for r in got:
        sums[source[r["_id"]]] += taken[r["_id"]]
        target[source[r["_id"]]] = r["_target"]
    assert all(abs(sums[s] - t) <= 1 for s, t in target.items())
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    again = {r["_id"]: sum(d["take"] for d in r["_draws"]) for r in mixing.draw(docs.repartition(5), []).collect()}
    assert again == taken
    whole = mixing.mix(docs)
    assert whole.columns == docs.columns
    words = {r.doc_id: r.n for r in whole.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert all(words.get(k, 0) == n for k, n in taken.items())
    assert mixing.mix(no_docs).count() == 0


def test_draws_follow_the_tree(docs, monkeypatch):
    """A second version of the draw: blocks by hash, runs of the tree's quotas, words cut in hash order."""
    shards, blocks, seed = 4, 16, 2
    source = F.col("source")
    hashed = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(source, F.lit("")).alias("src"), source.isNull().alias("none"), mixing.word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h")
    ).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.lit(blocks)))
    rows = hashed.withColumns({"p": F.xxhash64(F.lit(seed + 2), "src", F.col("block").cast("int")), "part": F.pmod(F.xxhash64(F.lit(seed + 5), "h", F.lit(None).cast("long")), F.lit(64))}).collect()
    names = sorted({(r.none, r.src) for r in rows})
    sizes = [sum(r["size"] for r in rows if (r.none, r.src) == n) for n in names]
    goal = mixing.targets(sizes, [mixing.WEIGHTS[k % 3] for k in range(len(names))], 1.5 * sum(sizes))
    order, quotas, plan = [], [], []
    for n, size, t in zip(names, sizes, goal):
        own = sorted({(r.p, r.block) for r in rows if (r.none, r.src) == n})
        words = [sum(r["size"] for r in rows if (r.none, r.src) == n and r.block == b) for _, b in own]
        passes = int(t // size)
        rest = min(size, round(t - passes * size))
        before = [sum(words[:k]) for k in range(len(own))]
        order.append([b for _, b in own])
        plan.append((passes, rest, before, words))
        quotas.append(passes * len(own) + sum(x < rest for x in before))
    tree = mixing.splitting_tree(quotas, shards, seed)
    want = Counter()
    for k, n in enumerate(names):
        passes, rest, before, words = plan[k]
        number = 0
        for shard in range(shards):
            for _ in range(int(tree[shard, k])):
                turn, place = divmod(number, len(order[k]))
                number += 1
                left = rest - before[place]
                for r in sorted((r for r in rows if (r.none, r.src) == n and r.block == order[k][place]), key=lambda r: (r.part, r.h, r.id)):
                    take = r["size"] if turn < passes else max(0, min(r["size"], left))
                    left -= r["size"]
                    if take:
                        want[r.id, turn + 1, shard] = take
    def drawn():
        return {(r["_id"], d["pass"], d["shard"]): d["take"] for r in mixing.draw(docs, [], shards=shards, blocks=blocks, seed=seed).collect() for d in r["_draws"] if d["take"]}

    got = drawn()
    assert got == dict(want) and len({s for _, _, s in got}) == shards

    def one_shard(quotas, shards, seed=0):
        import numpy as np

        return np.asarray([quotas] + [[0] * len(quotas)] * (shards - 1))

    monkeypatch.setattr(mixing, "splitting_tree", one_shard)
    assert drawn() != got  # the tree decides


def test_splitting_tree_is_exact():
    tree = mixing.splitting_tree([7, 0, 30, 11], 5, seed=3)
    assert tree.sum(axis=0).tolist() == [7, 0, 30, 11] and set(tree.sum(axis=1)) <= {9, 10} and (tree == mixing.splitting_tree([7, 0, 30, 11], 5, seed=3)).all()


def test_targets_reshare_the_excess():
    assert mixing.targets([10, 100, 100], [5.0, 2.0, 1.0], 315.0) == [20.0, pytest.approx(590 / 3), pytest.approx(295 / 3)]


def test_terms_equal_counts_by_hand(spark):
    """Disclosing terms against plain counts over all documents."""
    import random
    from math import log2

    rng = random.Random(9)
    common = [f"word{k}" for k in range(60)]
    rows = []
    for k in range(400):
        words = [rng.choice(common) for _ in range(12)]
        if k % 40 < 3:  # a few people, each with an address, a name and a handle, sometimes apart
            who = k // 40
            words.insert(rng.randrange(12), f"p{who}@mail.example.com")
            words += [f"Name{who},", f"h{who}x"] if k % 40 else [f"(Name{who})"]
        if k % 40 == 7:
            words.append(f"Name{k // 40}")
        if k % 40 in (8, 9, 10, 11):
            words.append(f"h{k // 40}x")
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
    rows.append((1000, None))
    terms, holds = {}, {}
    for k, text in rows:
        text = text or ""
        found = pii.base_spans(text.encode())
        for s, _, e in found:
            holds.setdefault(text[s:e].lower(), set()).add(k)
        inside = {text[s:e] for s, _, e in found}
        for w in text.split(" "):
            w = w.strip("(),")
            if w and w not in inside:
                terms.setdefault(w.lower(), set()).add(k)
    want = set()
    for docs in holds.values():
        for term, own in terms.items():
            n = len(docs & own)
            if n >= pii.SUPPORT and len(docs) * 2.0**pii.BITS <= len(rows) and n / len(own) >= pii.DISCLOSURE and log2(n / len(own) * len(rows) / len(docs)) >= pii.BITS:
                want.add(term)
    got = set()
    for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        for x in r.spans.split(",") if r.spans else ():
            kind, s, e = x.split(":")
            if kind == "term":
                got.add(rows[r.doc_id][1][int(s) : int(e)].lower())
    assert got == want and len(want) >= 5 and not want & set(common)


def test_mix_does_not_follow_the_partitions(spark):
    """Many equal rows, some of which the pass cuts: the same words are taken however the table is split."""
    rows = [(7, "one two three", "a")] * 900 + [(k, "w " * (k % 5), "a" if k % 3 else None) for k in range(1000)] + [(None, "x y", "a")] * 50 + [(9, None, "a")] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def taken(n):
        out = mixing.draw(frame.repartition(n), [], shards=3, blocks=2)
        return Counter((r["_id"], r["_size"], sum(d["take"] for d in r["_draws"])) for r in out.select("_id", "_size", "_draws").collect())

    first = taken(1)
    assert first == taken(7) and sum(first.values()) == len(rows)
    sums, goal = Counter(), {}
    for r in mixing.draw(frame, [], shards=3, blocks=2).collect():
        sums[r["_target"]] += sum(d["take"] for d in r["_draws"])
        goal[r["_target"]] = 1
    assert all(abs(s - t) <= 1 for t, s in sums.items()) and len(goal) == 2


def test_terms_lose_all_outer_punctuation(spark):
    import numpy as np

    data = b"a (((((b))))))) ,,,, !?c.d?!--; " + b"." * 50 + b"x " + b"." * 70
    starts, ends, _ = pii.words(np.frombuffer(data, np.uint8), np.asarray([0, len(data)]))
    got = [data[s:e] for s, e in zip(*pii._bare(np.frombuffer(data, np.uint8), starts, ends))]
    punct = "".join(map(chr, np.flatnonzero(pii._PUNCT))).encode()
    assert got == [w.strip(punct) for w in data.split(b" ")]
    rows = [(k, f"some (((((Zorbaxname?!?!?! bob@mail.example.com {k}") for k in range(3)] + [(9, "plain Zorbaxname here")] + [(10 + k, "common words here some plain") for k in range(200)]
    found = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:10:20" in found[0] and found[9] == "term:6:16"


def test_training_rows_of_one_id_are_bounded(spark, monkeypatch):
    frame = spark.range(20_000).selectExpr("1L doc_id", "concat('some text ', id % 5000) text", "'aa' lang").unionByName(spark.range(300).selectExpr("id + 10 doc_id", "concat('ein wort ', id) text", "'bb' lang"))
    seen = []
    monkeypatch.setattr(langid, "Model", seen.append)
    langid.train(frame)
    assert 1 <= len(seen[0]["aa"]) <= 2 * langid.TRAIN_DOCS and 1 <= len(seen[0]["bb"]) <= 2 * langid.TRAIN_DOCS and len(set(seen[0]["aa"])) == len(seen[0]["aa"])
