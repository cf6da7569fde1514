from topolane.llm import encoding_repair as E

CLEAN = [
    "La función sólo llega al nodo a través de la sesión.", "El índice quedó dañado por una copia incompleta.", "Für jede Lane gibt es genau einen gültigen Zustand, größere müssen früher.",
    "Каждая сессия хранит своё состояние. Почему ребро не разрешено?", "Повторите попытку после перезапуска.", "Nobody reads it — see the map. It’s cheaper…", "上限は2230トークンです。検証が失敗した理由を記録します。",
    "Le résumé dépasse déjà la limite.", "NÃO ALTERAR: PADRÃO DA INTEGRAÇÃO.", "Each node returns a list.",
]


def garble(s, written, read):
    return "".join(bytes([b]).decode(read, "replace") if b >= 128 and _ok(b, read) else chr(b) for b in s.encode(written))


def _ok(b, read):
    try:
        bytes([b]).decode(read)
        return True
    except UnicodeDecodeError:
        return False


def table(spark, extra):
    rows = [(i, f"s{i % 3}", "note", t, 1) for i, t in enumerate(CLEAN * 12)]
    rows += [(1000 + i, s, k, t, 1) for i, (s, k, t) in enumerate(extra)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, kind string, text string, chain int")


def test_find_and_restore(spark):
    extra = [
        ("s0", "note", garble(CLEAN[0], "utf-8", "cp1252")), ("s0", "note", garble(garble(CLEAN[1], "utf-8", "cp1252"), "utf-8", "cp1252")), ("s1", None, garble(CLEAN[4], "cp1251", "cp1252")),
        (None, "note", garble(CLEAN[2], "utf-8", "mac_roman")), ("s1", "note", "Les donn�es arrivent."), ("s2", "note", "It stored `GrÃ¶ÃŸe` for `Größe`."), ("s2", "note", "Bytes become U+FFFD (`�`)."),
        ("s2", "note", None), ("s2", "note", ""), ("s2", "note", " \n"), ("s0", "note", garble(CLEAN[0], "utf-8", "cp1252")), ("s0", "note", CLEAN[3] + " x " * 20000 + garble("sesión", "utf-8", "cp1252")),
    ]
    docs = table(spark, extra)
    judged = E.cut(E.judge(docs))
    bad = {r.doc_id for r in E.garbled(judged).collect()}
    assert bad == {1000, 1001, 1002, 1003, 1004, 1010, 1011}
    fixed = {r.doc_id: r for r in E.restored(docs, judged).collect()}
    for i, text in ((1000, CLEAN[0]), (1001, CLEAN[1]), (1002, CLEAN[4]), (1003, CLEAN[2]), (1010, CLEAN[0])):
        assert fixed[i].repaired == text
    assert fixed[1004].n_lost == 1 and fixed[1011].repaired.endswith("sesión")


def test_nothing(spark):
    empty = table(spark, []).limit(0)
    assert E.garbled(E.judge(empty)).count() == 0
    ascii_only = spark.createDataFrame([(1, None, None, "plain"), (2, "s", "k", None)], "doc_id bigint, source string, kind string, text string")
    assert E.garbled(E.judge(ascii_only)).count() == 0


def test_hypotheses():
    c = E.Chains.get()
    assert ("utf-8>cp1252", "ó") in c.hypotheses("Ã³") and c.hypotheses("é") in ([], c.hypotheses("é")) and c.hypotheses("a�")[0][0] == E.LOST
    assert dict((a, b) for a, b in c.hypotheses("獵牥›桔"))["utf-8>utf-16-le"] == "user: Th"


def test_text_beside_a_lost_character(spark):
    clean = "结果取决于行的顺序"
    bad = clean.encode().decode("gb18030", "replace")
    assert "\ue511" in bad and bad.endswith("\ufffd") and bad.count("\ufffd") == 1
    assert ("utf-8>gbk", clean[:-1]) in E.Chains.get().hypotheses(bad[:-1], "", "\ufffd")
    docs = table(spark, [("s0", "note", clean)] * 12 + [("s1", "note", bad)])
    judged = E.cut(E.judge(docs))
    fixed = {r.doc_id: r for r in E.restored(docs, judged).collect()}
    assert fixed[1012].repaired == clean[:-1] + "\ufffd" and (fixed[1012].n_units, fixed[1012].n_lost) == (2, 1)


def test_text_of_16_bits_read_byte_by_byte(spark):
    wide = "Each node returns a list."
    docs = table(spark, [("s0", "note", wide.encode("utf-16-le").decode("latin1")), ("s0", "note", "see: " + wide.encode("utf-16-be").decode("latin1") + " end"), ("s1", "note", "a\x00b"), ("s1", "note", "It stored `" + "GrÃ¶ÃŸe " * 40 + "` for `" + "Größe " * 40 + "`.")])
    judged = E.cut(E.judge(docs))
    assert {r.doc_id for r in E.garbled(judged).collect()} == {1000, 1001}
    fixed = {r.doc_id: r.repaired for r in E.restored(docs, judged).collect()}
    assert fixed[1000] == wide and fixed[1001] == f"see: {wide} end"
