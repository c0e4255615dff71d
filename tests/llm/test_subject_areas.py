import random

from siltstone.llm.subject_areas import Model, sentences, subject_areas

WORDS = {"chips": ["晶圆良率", "光刻设备", "芯片封测"], "food": ["乳制品铺市", "终端动销", "白酒吨价"], "law": ["诉讼判决", "仲裁申请", "财产保全"]}


def corpus(n, seed=1):
    r = random.Random(seed)
    plain = lambda: f"{r.choice('甲乙丙丁戊')}公司{r.randint(1, 99)}年管理费用基本持平并推进{r.choice(['降本增效', '流程再造'])}。"
    docs = []
    for i in range(n):
        own = r.sample(sorted(WORDS), r.choice([0, 1, 1, 1, 2]))
        parts = [plain() for _ in range(5)] + [f"{r.choice('子丑寅卯')}季度{r.choice(WORDS[s])}稳步改善{r.randint(1, 99)}%。" for s in own for _ in range(3)]
        if r.random() < 0.3:
            parts += [plain() for _ in range(8)] + [f"附带提到{r.choice(WORDS[r.choice(sorted(WORDS))])}。"] * (not own)
        r.shuffle(parts)
        docs.append((i, "".join(parts), r.choice(["a", "b", None]), set(own)))
    return docs


def test_held_out_accuracy():
    docs = corpus(400)
    model = Model([d[1] for d in docs[:250]], [d[2] for d in docs[:250]], [d[3] for d in docs[:250]], sorted(WORDS))
    got = model.label([d[1] for d in docs[250:]], [d[2] for d in docs[250:]])
    right = sum(set(g) == d[3] for g, d in zip(got, docs[250:], strict=True))
    assert right >= 0.95 * 150


def test_sentences():
    text = "甲公司为2.5%。是！ Revenue was 2.5 million. Costs\nfell. 乙公司增长"  # pieces without content don't count
    assert [x.strip() for x in sentences(text)] == ["甲公司为2.5%。", "Revenue was 2.5 million.", "Costs fell.", "乙公司增长"]


def test_tables(spark):
    docs = corpus(150)
    rows = [(d[0], d[1], d[2], "clash") for d in docs] + [(900, None, "a", "x"), (901, " ", "a", "x"), (902, "晶圆良率稳步改善。" * 20_000, "new", "x"), (903, docs[0][1], docs[0][2], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, subject string")
    labels = spark.createDataFrame([(d[0], s) for d in docs for s in d[3]] * 2 + [(5, "unknown"), (None, "food")], "doc_id bigint, subject string")
    subjects = spark.createDataFrame([(s,) for s in sorted(WORDS)], "subject string")
    got = [tuple(r) for r in subject_areas(df, labels, subjects).collect()]
    assert len(got) == len(set(got)) and (902, "chips") in got and not {900, 901} & {g[0] for g in got}
    assert {s for d, s in got if d == 903} == {s for d, s in got if d == docs[0][0]}
    right = sum({s for i, s in got if i == d[0]} == d[3] for d in docs if d[3])
    assert right >= 0.9 * sum(bool(d[3]) for d in docs)
    assert subject_areas(df.limit(0), labels, subjects).count() == 0 and subject_areas(df, labels.limit(0), subjects).count() == 0
