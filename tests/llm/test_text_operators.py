import base64
import random

import pytest

from opinara.llm import canon, p1_tokens, p3_language, p4_pairs, p5_confusables, p10_reading
from opinara.llm.labels import language_code

SCHEMA = "k int, t string, extra string"


@pytest.fixture(scope="module")
def table(spark):
    return canon.look_alikes(spark)


def test_trie_walk_is_exact():
    import tiktoken

    with open(p1_tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("t", pat_str=p1_tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    random.seed(5)
    pieces = {"".join(random.choice("abcdeé ñ日-.,01") for _ in range(random.randint(1, 30))) for _ in range(800)} | {"a" * 3000, "\n" * 500}
    walk = p1_tokens.TrieWalk(ranks)
    for p in sorted(pieces, key=str.encode):
        assert walk.tokens(p.encode()) == len(encode(p.encode()))


@pytest.mark.parametrize("known", [0, 3, 1000])
def test_document_tokens(spark, known):
    import tiktoken

    texts = [None, "", " \n", "El café, el CAFÉ!", "El café", "El café", "x" * 20_000, "señor 1234 日本", "it's fine  "]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "k int, t string, tokens string")
    encode = tiktoken.Encoding("t", pat_str=p1_tokens.PATTERN, mergeable_ranks=p1_tokens._ranks(p1_tokens.VOCABULARY), special_tokens={}).encode_ordinary
    got = {r.k: r.tokens for r in p1_tokens.totals(*p1_tokens.document_tokens(df, "t", ["k"], known=known), ["k"]).collect()}
    assert got == {i: len(encode(t or "")) for i, t in enumerate(texts)}


def test_token_budget_of_nothing_and_nulls(spark):
    shape = "text string, source string, language string, domain string, tokens int"
    assert [r.documents for r in p1_tokens.token_budget(spark.createDataFrame([], shape)).collect()] in ([], [None])
    rows = p1_tokens.token_budget(spark.createDataFrame([(None, None, None, None, 1), ("hola", "a", "Spanish", "b", 2)], shape)).collect()
    assert {(r.slice, r.documents, r.blank) for r in rows if r.slice == "all"} == {("all", 2, 1)}
    assert {r.language for r in rows if r.slice == "language"} == {"none", "es"}


def test_language_codes(spark):
    labels = {"es-ES": "es", " Español ": "es", "EN_us": "en", "català": "ca", "deu": "de", "fr": "fr", None: "none", "": "none", "??": "none", "n/a": "none", "und": "none", "it": "other", "Italian": "other"}
    df = spark.createDataFrame([(k,) for k in labels], "l string")
    assert {r.l: r.c for r in df.select("l", language_code(df.l).alias("c")).collect()} == labels


@pytest.mark.parametrize(
    ("text", "odd", "same_as"),
    [
        ("plain café ’ñ’ ü œuf “x”", False, "plain café ’ñ’ ü œuf “x”"),
        ("Ｃａｆé", True, "Café"),
        ("café", True, "café"),
        ("ca​fé", True, "café"),
        ("ca­fé", True, "café"),
        ("un café", True, "un café"),
        ("сafé", True, "café"),
        ("ﬁn", True, "fin"),
        ("ɡuapo", True, "guapo"),
        ("борщ y ラーメン", False, "борщ y ラーメン"),
        ("👨‍🍳 ❤️\n\t", False, "👨‍🍳 ❤️\n\t"),
        ("a‍b", True, "ab"),
    ],
)
def test_skeleton(table, text, odd, same_as):
    s = canon.skeleton(table)
    assert s.odd(text) is odd
    assert s.of(text) == s.of(same_as)


def test_confusables_queries(spark):
    rows = [(1, "café", "e"), (2, "café", "e"), (3, None, "e"), (4, "", "e"), (5, "té", "e"), (2, "café", "e"), (6, "с" * 50_000 + "a", "e")]
    df = spark.createDataFrame(rows, SCHEMA.replace("extra", "odd"))
    assert sorted(r.k for r in p5_confusables.odd_rows(df, "t", ["k"]).collect()) == [2, 6]
    groups = p5_confusables.skeleton_groups(df, "t", ["k"]).collect()
    assert sorted(r.k for r in groups) == [1, 2, 2] and {(r.rows, r.forms) for r in groups} == {(3, 2)} and len({r.form_hash for r in groups}) == 2
    pairs = [("coco", "сосо"), ("a-b", "a‐b"), ("a-b", "a–b"), ("l1", "ll"), ("rn", "m"), ("10", "lO"), ("Ｗｉｄｅ", "Wide"), ("été", "e\u0301te\u0301"), ("x", "y"), ("caña", "cana")]
    looks = spark.createDataFrame([(2 * i + j, f"{chr(0x4e00 + i)} {t}", 0) for i, p in enumerate(pairs) for j, t in enumerate(p)], "k int, t string, rows int")
    assert {r.k // 2 for r in p5_confusables.skeleton_groups(looks, "t", ["k"]).collect()} == set(range(8))
    assert p5_confusables.odd_rows(df.limit(0), "t", ["k"]).count() == 0
    assert {r.k: r.odd for r in p5_confusables.with_skeleton(df.where("k in (1, 3)"), "t", ["k"]).collect()} == {1: False, 3: False}


def test_odd_rows_are_those_that_differ_from_their_skeleton(spark, table):
    # Kelvin, Angstrom and Ohm signs equal single letters; a word in another script and joined emoji are ordinary
    rows = [(1, "5 \u212a"), (2, "\u212bngstr\u00f6m"), (3, "8 \u2126"), (4, "8 \u03a9 y 5 K"), (5, "\u0431\u043e\u0440\u0449"), (6, "\u0958\u0932"), (7, "\U0001f468\u200d\U0001f373"), (8, "q\u0303"), (9, "\u0441af\u00e9"), (10, "caf\u00e9")]
    df = spark.createDataFrame(rows, "k int, t string")
    found = p5_confusables.odd_rows(df, "t", ["k"])
    assert sorted(r.k for r in found.collect()) == [1, 2, 3, 8, 9]
    assert "skeleton" in found._jdf.queryExecution().analyzed().toString()
    s = canon.skeleton(table)
    assert s.of("8 \u2126") == s.of("8 \u03a9") and s.of("5 \u212a") == s.of("5 K")


def test_folded_words(table):
    words = canon.folder(table).words
    assert words("<b>Él</b> DIJO: «ca­fé» y​ té… ５") == ["el", "dijo", "cafe", "y", "te", "5"] == words("el dijo cafe y te 5")
    assert words(None) == words(" ... ") == []
    assert words("straße") == words("STRASSE")


def _corpus():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.01/dataset.parquet", columns=["row_no", "text", "language"]).to_pandas()


def test_languages_held_out(spark):
    """Accuracy on labels of rows outside the sample; labels are wrong for some rows, which bounds it."""
    df = spark.read.parquet("/root/testdata/sf0.01/dataset.parquet")
    found = p3_language.document_languages(df, sample=150).where("_label in ('en', 'es', 'ca', 'fr', 'de') and size(langs) = 1").select("_label", "langs").collect()
    right = sum(r._label == r.langs[0].lang for r in found)
    assert right / len(found) > 0.93


def test_families_segments_and_confidence(spark, model):
    """Documents put together of sentences that their rows' labels and a vote of both halves agree on come apart where they were joined."""
    df = spark.read.parquet("/root/testdata/sf0.1/dataset.parquet").where("row_no > 30000 and length(text) > 150")
    found = p3_language.languages(df.select("row_no", language_code(df.language).alias("c"), "text"), "text", ["row_no", "c"], model)
    clean = {}
    for r in found.where("size(langs) = 1 and size(segments) = 1 and langs[0].lang = c").select("row_no", "c").orderBy("row_no").collect():
        clean.setdefault(r.c, []).append(r.row_no)
    family = {x: f for f, xs in p3_language.FAMILIES.items() for x in xs}
    whole = found.where("c in ('en', 'es', 'ca', 'fr', 'de') and size(langs) = 1").select("c", "langs").collect()
    assert sum(family[r.c] == family[r.langs[0].lang] for r in whole) / len(whole) > 0.93
    # labels are wrong for some rows: sure answers agree with them more often than unsure ones
    sure = [r.c == r.langs[0].lang for r in whole if r.langs[0].confidence > 0.99]
    unsure = [r.c == r.langs[0].lang for r in whole if r.langs[0].confidence <= 0.99]
    assert len(sure) > len(unsure) and sum(sure) / len(sure) >= (sum(unsure) / len(unsure) if unsure else 0)
    pairs = list(zip(clean["es"][:100], clean["en"][:100], clean["ca"][:100]))
    texts = {r.row_no: r.text for r in df.where(df.row_no.isin([x for p in pairs for x in p])).select("row_no", "text").collect()}
    joined = spark.createDataFrame([(i, " ".join(texts[x].strip().rstrip(".") + "." for x in p)) for i, p in enumerate(pairs)], "k int, t string")
    got = [[s.lang for s in r.segments] for r in p3_language.languages(joined, "t", ["k"], model).collect()]
    assert sum(g == ["es", "en", "ca"] for g in got) / len(got) > 0.85


def test_languages_of_edge_cases(spark):
    es = "La comida estaba muy buena y el camarero nos atendió con una sonrisa. "
    en = "The food was very good and the waiter looked after us with a smile. "
    train = spark.read.parquet("/root/testdata/sf0.01/dataset.parquet")
    model = p3_language.fit(train, "text", "language", "row_no")
    rows = [(1, None, "e"), (2, " \n", "e"), (3, es * 3, "e"), (4, es * 2 + en * 2, "e"), (5, es * 4 + "Le gustó the window. ", "e"), (6, en * 3000, "e"), (7, "1234 !!", "e"), (3, es * 3, "e")]
    fr = "Le repas était très bon et le serveur nous a accueillis avec le sourire. "
    rows += [(8, es * 2 + en * 2 + fr * 2, "e"), (9, es * 9 + en, "e")]
    found = p3_language.languages(spark.createDataFrame(rows, SCHEMA.replace("extra", "langs2")), "t", ["k"], model)
    parts = {r.k: [x.lang for x in r.segments] for r in found.where("k > 7").collect()}
    assert parts == {8: ["es", "en", "fr"], 9: ["es", "en"]}
    got = {r.k: sorted(x.lang for x in r.langs) for r in p3_language.languages(spark.createDataFrame(rows, SCHEMA.replace("extra", "langs2")), "t", ["k"], model).collect()}
    assert got == {1: [], 2: [], 3: ["es"], 4: ["en", "es"], 5: ["es"], 6: ["en"], 7: [], 8: ["en", "es", "fr"], 9: ["es"]}
    assert p3_language.languages(spark.createDataFrame([], SCHEMA), "t", ["k"], model).count() == 0


REVIEW = "Esperamos mucho por la merluza y nadie pidió perdón. La terraza es preciosa y da al mar."
DONE = '\n{"service": "negative"}'


@pytest.mark.parametrize(
    ("answer", "defect"),
    [
        (None, "empty"),
        (" ​\n", "empty"),
        ("<think>\n\n</think>\n```json\n```", "empty"),
        (REVIEW, "copied"),
        ("Reseña: " + REVIEW.replace("merluza", "lubina") + " " + REVIEW, "copied"),
        ("Lo siento, pero no puedo ayudar con esta reseña.", "refusal"),
        ("Unfortunately I must decline to analyse this.\n{}", "refusal"),
        ("<think>Voy a leer otra vez la reseña", "truncated"),
        ('Este es el resultado: {"service": "neg', "truncated"),
        ("Voy a leer otra vez la reseña y miro de qué habla." + DONE, None),
        ("Voy a leer otra vez la reseña y miro de qué habla.\n{}", None),
        ("The review says «Esperamos mucho por la» and I should only keep what is stated outright." + DONE, "other_language"),
        (DONE, None),
    ],
)
def test_defects(spark, model, table, answer, defect):
    out = p4_pairs._defects(p4_pairs._rules(REVIEW, answer, canon.folder(table).words, p3_language.Plain(table), model))
    assert (out[0] if out else None) == defect


@pytest.mark.parametrize(
    ("answer", "rules"),
    [
        # every rule by itself, whatever else is triggered
        ("<think>", ["empty", "unclosed"]),
        ("I am sorry, but I am not permitted to rate any business in this way.\n{}", ["refusal", "language"]),
        (REVIEW + DONE, ["copied"]),
        (REVIEW + ' Lo siento, no estoy autorizado a valorarla. {"service": "neg', ["copied", "refusal", "no_map", "unclosed", "abrupt"]),
        ("The service was bad and the terrace is lovely.", ["no_map", "language"]),
        ("Se queja del servicio y la terraza le gusta" + DONE + "\nEn la terraza hay", ["abrupt"]),
        ("Se queja del servicio." + DONE + "\n```json", ["unclosed"]),
        ('Se queja del servicio.\n{"service": "negative"}\n{"service": "neg', ["no_map", "unclosed", "abrupt"]),
        ("这家餐厅的服务很慢，但是露台很漂亮。" + DONE, ["script"]),
        ("Non ci sono opinioni sul prezzo, però il servizio è stato lento e anche scortese; comunque gli è piaciuta molto la terrazza, perché si affaccia sul mare." + DONE, ["language"]),
        ("«Esperamos mucho por la merluza y nadie pidió perdón» habla del servicio, que aquí se juzga con dureza." + DONE, []),
    ],
)
def test_every_rule_is_tried(spark, model, table, answer, rules):
    got = p4_pairs._rules(REVIEW, answer, canon.folder(table).words, p3_language.Plain(table), model)
    assert got == rules


REFUSE = """This goes against my guidelines.|I am not permitted to rate businesses.|I'm unable to complete this task.|I'd prefer not to comment on this.|I have to pass on this one.
My policy does not allow me to label private texts.|This request cannot be processed.|No estoy autorizado a evaluar restaurantes.|No me está permitido analizar textos personales.|Mis normas me impiden valorar negocios.
Prefiero no opinar sobre este local.|No haré ninguna valoración.|No m'està permès fer aquesta anàlisi.|Les meves normes no em permeten etiquetar res.|Em sap greu, però no podré ajudar-te amb això.
Je ne suis pas autorise a evaluer ce texte.|Il m'est interdit d'analyser des avis.|Cela va à l'encontre de mes principes.|Nous ne pouvons pas traiter cette demande.
Das ist mir nicht erlaubt.|Ich bin dazu nicht befugt.|Ich lehne diese Anfrage ab.|Das verstößt gegen meine Richtlinien.|Ich darf dazu keine Bewertung abgeben."""
GO_ON = """You can't beat the paella here.|There is no opinion on service, so I leave it out.|I cannot find any opinion on the prices.|The kitchen will not make vegetarian dishes.|It is not right to count the price as negative.
No hay opinión sobre el vino, por eso lo dejo fuera.|El autor no puede quejarse del servicio.|No puedo encontrar opiniones sobre la terraza.|No volveré a este sitio.|L'autor no comenta res sobre el servei.|No tornaré mai més.
Je ne trouve aucun avis sur le service.|Je ne dois garder que ce qui est affirmé ouvertement.|Nous ne reviendrons pas.|Über die Preise sagt der Gast überhaupt nichts.|Ich kann keine Meinung zum Service finden.|Der Gast konnte nicht bezahlen."""


def test_refusals_are_told_from_other_denials():
    """Phrasings that stand in no table."""
    assert [x for x in REFUSE.replace("\n", "|").split("|") if not p4_pairs.refuses(x)] == []
    assert [x for x in GO_ON.replace("\n", "|").split("|") if p4_pairs.refuses(x)] == []


@pytest.fixture(scope="module")
def model(spark):
    train = spark.read.parquet("/root/testdata/sf0.01/dataset.parquet")
    return p3_language.fit(train, "text", "language", "row_no", seeds=p4_pairs.FUNCTION_WORDS)


def test_defects_of_a_table(spark):
    shape = "gen_id int, text string, raw_generation string, language string, defects int"
    rows = [(1, None, None, None, 0), (2, None, "{}", None, 0), (2, None, "{}", None, 0), (3, "", "x" * 30_000, "es", 0)]
    got = sorted((r.gen_id, tuple(r.defects)) for r in p4_pairs.defects(spark.createDataFrame(rows, shape)).collect())
    assert got == [(1, ("empty",)), (2, ()), (2, ()), (3, ("truncated",))]
    assert p4_pairs.defects(spark.createDataFrame([], shape)).count() == 0


def _advanced(spark, documents, anchors, asked):
    """Recall and precision of ``advanced`` on documents that two annotators or more agreed on, none of them seen."""
    from pyspark.sql import functions as F

    agreed = asked.dropDuplicates().groupBy("doc_id").agg(F.count("*").alias("n"), F.min("reading_level").alias("a"), F.max("reading_level").alias("b")).where("n > 1 and a = b").select("doc_id", "a")
    got = p10_reading.reading_levels(documents, anchors).join(agreed, "doc_id").where("level is not null").collect()
    true = {r.doc_id for r in got if r.a == "advanced"}
    found = {r.doc_id for r in got if r.level == "advanced"}
    assert len(true) >= 10
    return len(true & found) / len(true), len(true & found) / len(found)


def test_reading_levels_held_out(spark):
    """Half of the anchors of the larger table tell the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    anchors = spark.read.parquet("/root/testdata/sf0.1/reading_anchor.parquet")
    recall, precision = _advanced(spark, docs, anchors.where("pmod(xxhash64(doc_id), 2) = 0"), anchors.where("pmod(xxhash64(doc_id), 2) = 1"))
    assert recall >= 0.9 and precision >= 0.9


def test_reading_levels_of_few_anchors(spark):
    """The 40 annotated documents of the small table, some of them rated wrongly, tell all documents of the larger one."""
    from pyspark.sql import functions as F

    docs, anchors = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "reading_anchor"))
    more, asked = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet").withColumn("doc_id", -1 - F.col("doc_id")) for t in ("documents", "reading_anchor"))
    recall, precision = _advanced(spark, docs.unionByName(more), anchors, asked)
    assert recall >= 0.9 and precision >= 0.9


def test_levels_outlast_wrong_annotations():
    import numpy as np

    rng = np.random.default_rng(3)
    true = np.repeat([0, 1, 2], [20, 60, 20])
    x = rng.normal(0, 0.4, (100, 4)) + np.array([-2.0, 0, 2])[true][:, None]
    votes = np.zeros((100, 3))
    for i in range(0, 100, 3):
        votes[i, true[i]] = 1
    votes[0], votes[99] = [0, 0, 1], [0, 1, 0]
    q, w = p10_reading._fit_documents(x, votes)
    assert (q.argmax(axis=1) == true).all()
    votes[:, 2] = 0
    assert (p10_reading._fit_documents(x, votes)[0].argmax(axis=1) < 2).all()


def test_reading_levels_of_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "  ", 0), (3, "Hola. El pan es bueno.", 0), (3, "Hola. El pan es bueno.", 0)], "doc_id long, text string, level int")
    none = spark.createDataFrame([], "doc_id long, annotator string, reading_level string")
    got = sorted((r.doc_id, r.sentences) for r in p10_reading.reading_levels(docs, none).collect())
    assert got == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert p10_reading.reading_levels(docs.limit(0), none).count() == 0
