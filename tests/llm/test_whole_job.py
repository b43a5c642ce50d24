"""Cases that a review found left out."""

from factloom.llm import decontam, html_extract, line_dedup


def words(k, n):
    return " ".join(f"w{(k * 7919 + j * j * 31 + j) % 99991}x".translate(str.maketrans("0123456789", "abcdefghij")) for j in range(n))


def dropped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_recurring_lines(df).collect()}


def test_op7_more_shared_than_own_lines(spark):
    boiler = "Home and news and more\nAll rights reserved here\n"
    pages = [boiler + words(k, 30) for k in range(5)]
    assert dropped(spark, pages) == {0: 0, 1: 2, 2: 2, 3: 2, 4: 2}


def test_op7_whole_one_line_texts(spark):
    passage = words(99, 50)
    texts = [" ".join([str(k), passage[:60], str(k * 3 + 1), passage[60:150], str(k * 7 + 2), passage[150:], str(k * 9)]) for k in range(4)]
    assert dropped(spark, texts) == {0: 0, 1: 1, 2: 1, 3: 1}


def test_op7_long_line_in_two_texts(spark):
    passage = words(5, 60)
    assert dropped(spark, [passage + "\n" + words(1, 40), passage + "\n" + words(2, 40)]) == {0: 0, 1: 1}


def test_op7_counts_are_parameters(spark):
    """With equal counts a long line needs as many texts as a short one."""
    long, short = " ".join(f"word{chr(97 + k)}" for k in range(20)), "five words of a line"
    own = lambda k: " ".join(f"{chr(97 + k)}{chr(97 + j)}own" for j in range(12))
    docs = spark.createDataFrame([(k, f"{own(k)}\n{long}\n{short}") for k in range(2)] + [(k, own(k)) for k in range(2, 5)], "doc_id bigint, text string")
    dropped = lambda **n: sum(r["n_dropped"] for r in line_dedup.drop_recurring_lines(docs, **n).collect())
    assert (dropped(), dropped(min_texts_long=3), dropped(min_texts=2), dropped(min_texts=3, min_texts_long=9)) == (1, 0, 2, 0)


def test_op7_near_copies_count_once(spark):
    lines = [words(k, 12) for k in range(40)]
    copies = ["\n".join(lines[:k] + [words(500 + k, 12)] + lines[k + 1 :]) for k in range(6)]
    assert dropped(spark, copies) == dict.fromkeys(range(6), 0)


def near_items(spark, item, texts):
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: (r["items"], r["near_items"]) for r in decontam.find_matches(df, bench).collect()}


def test_op10_rarest_word_lost(spark):
    item = [f"common{'abcdefghijklmnop'[j]}" for j in range(16)]
    item[8] = "rare"
    changed = [*item[:8], "other", *item[9:]]
    filler = " ".join(w for w in item if w != "rare")
    found = near_items(spark, " ".join(item), [" ".join(changed), " ".join(item), " ".join(changed[1:]), *[" ".join(reversed(filler.split()))] * 3])
    assert found[0] == ([], ["1"]) == found[2] and found[1] == (["1"], []) and found[3] == ([], [])


def test_op10_short_item(spark):
    found = near_items(spark, "one two three four five six seven eight", ["one two three xx five six seven eight", "one two xx xx five six seven eight", "one two three four five six seven eight"])
    assert found == {0: ([], ["1"]), 1: ([], []), 2: (["1"], [])}


def test_op10_words_lost_where_a_text_begins(spark):
    item = "one two three four five six seven eight nine ten"
    found = near_items(spark, item, ["nothing here", "three four five six seven eight nine ten", "one two three four five six seven eight"])
    assert found == {0: ([], []), 1: ([], ["1"]), 2: ([], ["1"])}


def test_pipeline_near_matches_go(spark, tmp_path):
    import corpus_pipeline

    item = [f"common{'abcdefghijklmnop'[j]}" for j in range(16)]
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, " ".join([*item[:8], "other", *item[9:]])), (2, "nothing of the kind")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()] == [2]


def test_op6_head_without_end_tag():
    model = html_extract.train(html_extract.labelled_pages())
    sentence = "A sentence of the article with a number of words in it, as articles have. "
    article = f"<article><h1>Heading of it</h1><p>{sentence * 4}</p><p>{sentence * 3}</p></article>"
    head = "<html><head><meta charset=utf-8><title>x</title><style>p{}</style><script>1</script>"
    want = html_extract.extract(f"{head}</head><body>{article}</body></html>", model)
    assert sentence.strip() in want
    for page in (f"{head}<body>{article}</body></html>", f"{head}\n{article}</html>", f"{head}<noscript><p>y</p></noscript><body>{article}"):
        assert html_extract.extract(page, model) == want
    seen = [text for k, text in html_extract.parse("<head><title>x</title>\n Words &amp; more")[1] if k >= 0]
    assert "".join(seen).split() == ["Words", "&", "more"]
