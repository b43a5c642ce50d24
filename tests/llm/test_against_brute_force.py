"""The registered queries against plain reimplementations, on the smallest tables and on made ones."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from factloom.llm import decontam, line_dedup, near_dedup, pii, quality, queries, suffix_dedup

import public_tokenizers

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name):
    return {r["doc_id"]: r for r in queries.queries()[name](spark, SF).collect()}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_op1(spark):
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = rows_of(spark, "op1_language_id")
    held = [k for k in known if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k, r in found.items() if r["held_out"]} == set(held)
    assert np.mean([found[k]["lang_pred"] == known[k] for k in held]) > 0.95


def base_spans(text):
    out = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for k, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


def test_op2(spark, docs):
    found = rows_of(spark, "op2_personal_data")
    assert all(found[k]["base_sha256"] == sha(base_spans(t)) for k, t in docs.items())
    assert all(set(filter(None, base_spans(t).split(","))) <= set(found[k]["spans"].split(",")) for k, t in docs.items())


def test_op2_random_texts():
    automaton, draw = pii.build_automaton(), random.Random(5)
    parts = ["a", "b.", "@", "@x.", ".", "1", "25", "256.", "10.", "+", "+1", " ", "-", "(", ")", "%", "4111 1111 1111 1111", "é", "www.", "://", "token="]
    for _ in range(5000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 25)))
        assert pii.listed([s for s in pii.find(text, automaton) if s[0] in pii.BASE_KINDS]) == base_spans(text)


def test_op2_added_kinds():
    automaton = pii.build_automaton()
    text = 'See https://example.org/a?b=1. Write bob [at] example [dot] org, IBAN DE89 3704 0044 0532 0130 00, SSN 123-45-6789, token = "0123456789abcdef", 12 Long Oak Street.'
    found = {k: text[a:b] for k, a, b in pii.find(text, automaton)}
    assert found["url"] == "https://example.org/a?b=1" and found["masked_email"] == "bob [at] example [dot] org"
    assert found["iban"] == "DE89 3704 0044 0532 0130 00" and found["national_id"] == "123-45-6789"
    assert found["secret"] == "0123456789abcdef" and found["street"] == "12 Long Oak Street"


def test_op3(spark, docs):
    found = rows_of(spark, "op3_quality_rules")
    for k, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        starts = defaultdict(list)
        for j in range(len(words) - 4):
            starts[tuple(words[j : j + 5])].append(j)
        cover = {x for v in starts.values() if len(v) > 1 for j in v for x in range(j, j + 5)}
        r = found[k]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(cover))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["base_failed"] == (len(words) < 10 or 100 * len(cover) > 20 * len(words)) and not (r["base_failed"] and r["kept"])


CLEAN = {
    "Hindi": "यह एक छोटी कहानी है जिसमें एक लड़का नदी के किनारे बैठा था और दूर पहाड़ों को देख रहा था। उसकी माँ ने उसे घर बुलाया, क्योंकि शाम हो चुकी थी।",
    "Tamil": "இது ஒரு சிறிய கதை, அதில் ஒரு சிறுவன் ஆற்றங்கரையில் அமர்ந்து தூரத்தில் உள்ள மலைகளைப் பார்த்துக் கொண்டிருந்தான் என்று சொல்லப்பட்டது.",
    "Thai": "วันนี้อากาศดีมาก เด็กชายคนหนึ่งนั่งอยู่ริมแม่น้ำ มองภูเขาที่อยู่ไกลออกไป แม่เรียกเขากลับบ้าน เพราะเย็นแล้ว เขาลุกขึ้นยืน แล้วเดินกลับช้าๆ ระหว่างทางเขาพบเพื่อน ทั้งสองคุยกัน จนถึงหน้าบ้าน แล้วแยกย้าย",
    "Chinese": "\n".join(f"第{k}段讲的是一个男孩坐在河边，看着远处的山；他的母亲叫他回家，因为天已经黑了。" for k in "一二三四五六七八九十甲乙"),
    "Japanese": "\n".join(f"その{k}の話では、少年が川のそばに座って、遠くの山を見ていました。母は夕方になったので彼を呼びました。" for k in "一二三四五六七八九十甲乙"),
}


def test_op3_keeps_clean_texts_of_other_scripts(spark):
    docs = spark.createDataFrame([*CLEAN.items(), ("glued", "x" * 40 + " " + " ".join(["y" * 30] * 12))], "doc_id string, text string")
    found = {r["doc_id"]: r for r in quality.judge(quality.ledger(docs)).collect()}
    assert [k for k in CLEAN if not found[k]["kept"]] == []
    assert not found["glued"]["kept"]


def test_op3_ablations(spark):
    ledger = quality.ledger(spark.createDataFrame([(1, "a b c"), (2, "one two three four five six seven eight nine ten"), (3, "### $$$ &&& *** ||| <<< >>> %%% ### $$$")], "doc_id int, text string"))
    found = {r["rule"]: r for r in quality.ablations(ledger).collect()}
    assert found["few_words"]["n_failed"] == 1 and found["symbols"]["n_failed"] == 1 and len(found) == len(quality.POLICIES["v1"])
    masks = [r["failed"] for r in ledger.collect()]
    mask = quality.mask_of(quality.POLICIES["v1"])
    for r in quality.RULES:
        assert found[r.name]["n_kept_without"] == sum((m & mask & ~(1 << r.bit)) == 0 for m in masks)


def test_op4(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    found = {r["doc_id"]: r for r in queries.op4_toxicity(spark, "/root/testdata/sf0.01").collect()}
    held = [k for k in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(found[k]["held_out"] for k in held) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found.values())
    toxic = [found[k]["predicted"] for k in held if labels[k]]
    clean = [found[k]["predicted"] for k in held if not labels[k]]
    assert np.mean(toxic) > 0.6 and np.mean(clean) < 0.03


def repeats(texts):
    data = {k: t.encode() for k, t in texts.items()}
    counts = Counter(b[j : j + 200] for b in data.values() for j in range(len(b) - 199))
    out = {}
    for k, b in data.items():
        cover = np.zeros(len(b) + 1, int)
        for j in range(len(b) - 199):
            if counts[b[j : j + 200]] > 1:
                cover[j] += 1
                cover[j + 200] -= 1
        on = np.cumsum(cover)[:-1] > 0
        out[k] = (len(b), int(on.sum()), int((np.diff(np.concatenate(([0], on.astype(int)))) == 1).sum()), sha(np.frombuffer(b, np.uint8)[~on].tobytes()))
    return out


def test_op5(spark, docs):
    found = rows_of(spark, "op5_repeated_strings")
    assert repeats(docs) == {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in found.items()}


def test_op5_made_texts(spark, monkeypatch):
    draw = random.Random(7)
    pool = ["".join(draw.choice("abé ") for _ in range(draw.choice([150, 199, 230, 400]))) for _ in range(6)] + ["a" * 500, "ab" * 260]
    texts = {k: "".join(draw.choice(pool)[draw.randint(0, 40) :] + draw.choice(["", "x", "yy"]) for _ in range(draw.randint(0, 5))) for k in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = repeats(texts)
    for hot in (suffix_dedup.HOT, 3):  # 3: the path for pieces with very many surroundings
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        found = suffix_dedup.digests(suffix_dedup.remove_repeats(df)).collect()
        assert want == {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found}


def test_op6(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op6_main_text(spark, SF).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        want = " ".join(b for b in blocks if b)
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_op6_other_layouts():
    from factloom.llm import html_extract
    from factloom.llm.labelled_pages import Writer, labelled_pages

    model, good, total = html_extract.train(labelled_pages()), 0, 0
    for k in range(10_000, 10_080):
        nodes, _ = html_extract.parse(Writer(k).page())
        labels = []
        for x in nodes:
            labels.append(int(x.label) if x.label is not None else labels[x.parent] if x.parent >= 0 else 0)
        for x, y, p in zip(nodes, labels, html_extract.marginals(nodes, model), strict=True):
            if x.tag == "#text":
                good, total = good + ((p > 0.5) == y), total + 1
    assert good / total > 0.95


def test_op7_templates(spark):
    keys = line_dedup.template_keys(["user 17 logged in", "user 4711 logged in", "user 17 logged out", "user alice logged in", "user bob logged in", "user alice logged out", "one two three"])[0].tolist()
    assert keys[0] == keys[1] and keys[0][0] != keys[2][0]
    assert keys[3][1] == keys[4][1] == keys[0][1] != keys[5][1] and keys[3][0] != keys[4][0]  # the second token is variable
    assert line_dedup.template_keys(["one two three"])[1].tolist() == [[3, 0, 0, 0]]
    boiler = ["Page {} of our site, all rights reserved", "Posted by {} in News today"]
    names = "Alice Bob Carol Dan Eve Frank".split()
    texts = [f"own line {'abcdefgh'[k]} one\nan other line {'abcdefgh'[k]} two\n{boiler[0].format(k)}\n{boiler[1].format(names[k])}" for k in range(6)] + ["the same text\nin three lines\nagain and again"] * 4 + [None, ""]
    texts = [t.replace("own line", f"{'mnopqr'[k]} line").replace("an other", f"{'mnopqr'[k]} other") if t and k < 6 else t for k, t in enumerate(texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in line_dedup.drop_recurring_lines(df).collect()}
    assert [found[k]["n_dropped"] for k in range(6)] == [0, 2, 2, 2, 2, 2] and found[3]["text"] == "p line d one\np other line d two"
    assert all(found[k]["n_dropped"] == 0 for k in range(6, 12))


def lines_to_drop(texts, classes):
    """Places of dropped lines by brute force: all pairs of a template and a text."""
    carriers = defaultdict(list)
    for k, text in texts.items():
        for j, line in enumerate(text.split("\n")):
            if not re.search(r"[^ \t\r\f\x0b]", line):
                continue
            tokens = [("<*>" if re.search(r"[0-9@]|://", t) else t) for t in line.split()]
            n, rest = len(tokens), max(0, len(tokens) - 1)
            cuts = [1 + rest * f // 3 for f in range(4)]
            carriers[tuple(tokens), 2 if n >= 16 else 3].append((k, j))
            for f in range(3):
                a, b = cuts[f], cuts[f + 1]
                if b > a and n - (b - a) >= 3:
                    carriers[(n, f, *tokens[:a], *tokens[b:]), 3].append((k, j))
    out = defaultdict(set)
    for (_, need), rows in carriers.items():
        if len({classes[k] for k, _ in rows}) >= need:
            first = min(k for k, _ in rows)
            for k, j in rows:
                if k != first:
                    out[k].add(j)
    return out


def test_op7_which_lines_go(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    keyed = {hashlib.md5(t.encode()).digest(): k for k, t in docs.items()}
    rows = df.selectExpr("unhex(md5(text)) AS text_key", "text").dropDuplicates(["text_key"])
    by_key = {bytes(r["text_key"]): bytes(r["class"]) for r in near_dedup.estimated_classes(rows, "text_key").collect()}
    assert set(by_key) == set(keyed)
    classes = {k: by_key[hashlib.md5(t.encode()).digest()] for k, t in docs.items()}
    want = lines_to_drop(docs, classes)
    found = {r["doc_id"]: r for r in line_dedup.drop_recurring_lines(df).collect()}
    assert any(want.values())
    for k, text in docs.items():
        assert found[k]["n_dropped"] == len(want[k])
        assert found[k]["text"] == "\n".join(x for j, x in enumerate(text.split("\n")) if j not in want[k])


def test_estimated_classes(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "name bigint, text string")
    found = {r["name"]: r["class"] for r in near_dedup.estimated_classes(df.selectExpr("cast(cast(name AS string) AS binary) AS name", "text"), "name").collect()}
    found = {int(k): bytes(v) for k, v in found.items()}
    exact = {k: c for k, (_, c) in near(docs, 5).items()}
    together = [found[k] == found[c] for k, c in exact.items() if k != c]
    apart = len(set(found.values())) / len(set(exact.values()))
    assert np.mean(together) > 0.9 and 0.95 < apart < 1.1


def test_op7_lines(spark, docs):
    found = rows_of(spark, "op7_recurring_lines")
    assert set(found) == set(docs)
    assert all(r["n_lines"] == sum(bool(re.search(r"[^ \t\r\f\x0b]", x)) for x in docs[k].split("\n")) for k, r in found.items())


def near(texts, size):
    sets = {}
    for k, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        n = min(size, len(words))
        sets[k] = frozenset(zip(*(words[j:] for j in range(n)))) if words else frozenset()
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in texts}


def test_op8(spark, docs):
    found = rows_of(spark, "op8_near_duplicates")
    assert near(docs, 2) == {k: (r["n_shingles"], r["component_id"]) for k, r in found.items()}
    assert all(r["kept"] == (k == r["component_id"]) for k, r in found.items())


def test_op8_chains(spark):
    draw = random.Random(11)
    texts, words = {}, [f"w{draw.randint(0, 5000)}" for _ in range(200)]
    for k in range(120):  # each text a few words from the one before it, so links form long chains; and copies
        if draw.random() < 0.8:
            words = list(words)
            for _ in range(draw.choice([0, 1, 2, 4, 9])):
                words[draw.randrange(len(words))] = f"w{draw.randint(0, 5000)}"
        else:
            words = [f"w{draw.randint(0, 5000)}" for _ in range(draw.choice([1, 2, 30, 200]))]
        texts[k] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for size in (2, 5):
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, shingle=size).collect()}
        assert found == near(texts, size)


def test_op8_pigeonhole():
    draw = np.random.default_rng(3)
    for _ in range(200):
        a = draw.integers(0, 256, near_dedup.SYMBOLS, dtype=np.uint8)
        b = a.copy()
        at = draw.choice(near_dedup.SYMBOLS, near_dedup.THRESHOLD, replace=False)
        b[at] ^= 1
        assert np.intersect1d(near_dedup.keys_of(a[None]), near_dedup.keys_of(b[None])).size


def test_op9(spark, docs):
    from factloom.llm.bpe import read_ranks

    ranks = {t: k for k, t in enumerate(read_ranks(public_tokenizers.path(queries.RANKS)))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = rows_of(spark, "op9_byte_bpe")
    for k, text in docs.items():
        ids = encoding.encode_ordinary(text)
        assert (found[k]["n_tokens"], found[k]["ids_sha256"], found[k]["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text))


def test_op9_odd_texts():
    from factloom.llm.bpe import Codec, read_ranks, serialise_model

    tokens = read_ranks(public_tokenizers.path(queries.RANKS))
    codec = Codec(serialise_model(tokens), public_tokenizers.PATTERN)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    draw = random.Random(1)
    texts = ["".join(draw.choice("ab  \n\t\x00\x1c\x85\xa0aéñ漢字🎉<|endoftext|>▁Ġ 1234  ") for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert ids == np.array(encoding.encode_ordinary(text), "<u4").tobytes() and codec.decode(ids) == text.encode()


def windows(bench):
    out = defaultdict(set)
    for item, text in bench.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
        for j in range(max(1, len(words) - 9) if words else 0):
            out[tuple(words[j : j + 10])].add(str(item))
    return out


@pytest.mark.parametrize("block_chars", [None, 2500])
def test_op10(spark, docs, block_chars):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = windows({r["item_id"]: r["text"] or "" for r in bench.collect()})
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = {r["doc_id"]: r for r in (queries.op10_benchmark_matches(spark, SF) if block_chars is None else decontam.digests(decontam.find_matches(table, bench, block_chars=block_chars))).collect()}
    for k, text in docs.items():
        words, hit, own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER)), set(), set()
        for size in {len(w) for w in items}:
            for j in range(len(words) - size + 1):
                if (w := tuple(words[j : j + size])) in items:
                    hit |= set(range(j, j + size))
                    own |= items[w]
        r = found[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(words), len(hit), len(own), sha(",".join(sorted(own))), bool(hit))


def test_op10_proximity(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "one two three four xx five six seven eight nine ten"), (2, "one two three four five six seven eight nine ten"), (3, "ten nine")], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in decontam.find_matches(docs, bench).collect()}
    assert found[1]["items"] == [] and found[1]["near_items"] == ["1"] and found[2]["items"] == ["1"] and found[2]["near_items"] == [] == found[3]["near_items"]


def test_op10_rows_of_the_index(spark, monkeypatch):
    """The same matches whether documents share rows of the index or each has its own, and in a very long document."""
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "alpha beta")], "item_id bigint, text string")
    long = "filler word " * 40_000 + " ".join(words) + " alpha"
    docs = spark.createDataFrame([(1, long), (2, "alpha beta"), (3, ""), (4, None), (5, "beta alpha beta"), (6, " ".join(words[:10]))], "doc_id bigint, text string")
    found = []
    for places in (decontam.PLACES, 70):
        monkeypatch.setattr(decontam, "PLACES", places)
        found.append({r["doc_id"]: (r["n_words"], r["hits"], r["items"]) for r in decontam.find_matches(docs, bench, near=False).collect()})
    assert found[0] == found[1] == {1: (80_013, [80_000, 80_012], ["1"]), 2: (2, [0, 2], ["2"]), 3: (0, [], []), 4: (0, [], []), 5: (3, [1, 3], ["2"]), 6: (10, [0, 10], ["1"])}


def test_op10_any_lost_word(spark):
    """Near matches are found whichever word of the window is lost, the rarest included."""
    words = "one two three four five six seven eight nine ten".split()
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, " ".join([*words[:k], "other", *words[k + 1 :]])) for k in range(10)] + [(99, "one two three four five " * 50)], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in decontam.find_matches(docs, bench).collect()}
    assert all(found[k]["near_items"] == ["1"] and found[k]["items"] == [] for k in range(10)) and found[99]["near_items"] == []


def test_op5_rows_that_differ_in_zeros_only():
    data = [b"ab\0\0", b"ab", b"ab\0\0", b"ab\0", b"ab\0\0c"]
    rows = np.zeros((len(data), 5), np.uint8)
    for k, x in enumerate(data):
        rows[k, : len(x)] = np.frombuffer(x, np.uint8)
    order, common = suffix_dedup.common_prefixes(rows, np.array([len(x) for x in data]), np.zeros(len(data), int))
    assert [data[k] for k in order] == sorted(data)
    assert common.tolist() == [-1, 2, 3, 4, 4]
