import json

import pytest

from corpusmill.llm import pii
from tests.conftest import rows


def kinds(text):
    plain = text.translate(pii.FULL_WIDTH)
    return sorted((k, text[a:b]) for a, b, k in pii.shaped(plain).found)


@pytest.mark.parametrize(
    "text,want",
    [
        ("see mailto:ana.b+x@lab.example.", [("email", "ana.b+x@lab.example")]),
        ("mail ana_b9 (at) post.test or", [("email", "ana_b9 (at) post.test")]),
        ("ana [at] desk [dot] example [dot] com;", [("email", "ana [at] desk [dot] example [dot] com")]),
        ("to ana at lab dot example today", [("email", "ana at lab dot example")]),
        ("写信到 ana＠lab.example 。", [("email", "ana＠lab.example")]),
        ("deploy@node-12 pinned ring@2.1.0 qx/traces@a44f:notes stalls at depth 8 (dot product)", []),
        ("Ring +49 30 23125 320 twice", [("phone", "+49 30 23125 320")]),
        ("tel:(212) 555 0190, 030/23125-461", [("phone", "(212) 555 0190"), ("phone", "030/23125-461")]),
        ("拨打 ０７５５ ５５５０ ０１０７ 。", [("phone", "０７５５ ５５５０ ０１０７")]),
        ("shape 201-621-92655 build 1.9.555.0193 10.2.3.4 2031-09-23 03:23 QXR-190-1981", []),
        ("SSN 959 34 9295 and 959-34-9295.", [("id_number", "959 34 9295"), ("id_number", "959-34-9295")]),
        ("证件：99645219911022558X 计数器 264540976877432198", [("id_number", "99645219911022558X")]),
        ("passport no. QZ4197910, X8TL04902", [("id_number", "QZ4197910"), ("id_number", "X8TL04902")]),
        ("at 12 Alder St.,\nTalmere, QX 00904 and", [("address", "12 Alder St.,\nTalmere, QX 00904")]),
        ("at 12 Alder Court, Apt 7A, Port-Alder 00654;", [("address", "12 Alder Court, Apt 7A, Port-Alder 00654")]),
        ("at 12 Heron Way, Highmoor QZ1 6XW is", [("address", "12 Heron Way, Highmoor QZ1 6XW")]),
        ("at Lindenallee 437, 05306 Brindleford and", [("address", "Lindenallee 437, 05306 Brindleford")]),
        ("5 Lane Street is a path, 8 Drive partitions, 5 Court of Law", []),
        ("", []),
    ],
)
def test_shapes(text, want):
    assert kinds(text) == sorted(want)


def test_chinese_address_with_and_without_a_known_city(spark):
    texts = ["地址：青汀市松间区石桥路4号", "松原口市松间区石桥路4号。", "请寄到青汀市松间区石桥路441号24栋。", "寄松原口市松间区石桥路5号3单元9室", "请把它们都寄长洲市松间区石桥路6号"]
    got = [(r["record_id"], r["value"], r["start"]) for r in pii.personal_spans(parts(spark, texts)).orderBy("record_id").collect()]
    assert got == [
        ("u0", "青汀市松间区石桥路4号", 3), ("u1", "松原口市松间区石桥路4号", 0), ("u2", "青汀市松间区石桥路441号24栋", 3),
        ("u3", "松原口市松间区石桥路5号3单元9室", 1), ("u4", "长洲市松间区石桥路6号", 6),
    ]
    assert all(texts[int(i[1:])][a : a + len(v)] == v for i, v, a in got)


def test_loose_forms_in_contexts_of_known_ones(spark):
    texts = [f"My direct line: 212-555-01{i:02} if needed." for i in range(40)] + ["My direct line: 5550 19 77 123 if needed.", "Rows: 5550 19 77 124 in all."]
    texts += [f"Her passport number is QZ41979{i:02}." for i in range(40)] + ["Her passport number is 4197-QX-910.", "Build no. 4197-QX-911."]
    texts += [f"Write to u{i}@lab.example today." for i in range(40)] + ["Write to ana@mailhost today.", "Log in as ana@nodehost today."]
    spans = pii.personal_spans(parts(spark, texts))
    loose = {(r["kind"], r["value"]) for r in spans.where("score < 0.9").collect()}
    assert loose == {("phone", "5550 19 77 123"), ("id_number", "4197-QX-910"), ("email", "ana@mailhost")}
    hidden = pii.personal_spans(parts(spark, texts), hidden=0.3).where("score < 0.95")
    assert hidden.where("pattern is null").count() == 0 and hidden.count() >= 15


def parts(spark, texts):
    data = [("graded_units", f"u{i}", "body", t, 0, 0) for i, t in enumerate(texts)]
    schema = "record_table string, record_id string, part string, text string, kind int, score int"
    return spark.createDataFrame(data, schema).select("record_table", "record_id", "part", "text")


GIVEN = ["Ana", "Bela", "Ciro", "Dora", "Edda", "Fabio", "Gita", "Hugo"]
FAMILY = ["Wendholt", "Raskby", "Ilvish", "Tandova", "Grynaux"]


def corpus():
    texts = [f"| {g} {f} | {g.lower()}@lab.example | 212-555-0101 |" for g in GIVEN for f in FAMILY[:3]]
    texts += [f"Reported by {g} {f}." for g in GIVEN for f in FAMILY[2:]]
    texts += [f"Run {i} is done. Reported by Nightly Runner." for i in range(9)]
    texts += ["Reported by Zelda Umbrix.", "Thanks to BELA K. TANDOVA for it.", "Ask Grynaux, Dora first.", "Owner: Graph Desk"]
    texts += [f"联系人：{n}\n邮箱：x@lab.example" for n in ("简岚澄", "车澄岚", "鹿岚舟", "简舟澄")]
    texts += ["感谢鹿舟岚提供的文件。", "感谢车岚舟提供的文件。", "由自动流程复核。"]
    return texts


def test_names_are_bootstrapped(spark):
    spans = pii.personal_spans(parts(spark, corpus()))
    names = {r["value"] for r in spans.where("kind = 'name'").collect()}
    assert {f"{g} {f}" for g in GIVEN for f in FAMILY} <= names
    assert {"Zelda Umbrix", "BELA K. TANDOVA", "Grynaux, Dora", "简岚澄", "鹿舟岚", "车岚舟"} <= names
    assert not {"Nightly Runner", "Graph Desk"} & names


def test_chinese_names_of_characters_in_no_seed(spark):
    seeds = [f + g for f in "简车鹿闻楚" for g in ("岚澄", "舟澄", "澄岚")]
    texts = [f"联系人：{n}\n邮箱：x@lab.example" for n in seeds]
    texts += [f"今天感谢{f}{g}提供的文件。" for f in "简车鹿闻楚" for g in ("岚舟", "舟岚")]
    texts += ["今天感谢欧锦荣提供的文件。", "联系人：赵德\n邮箱：未填写", "联系人：欧阳雅婷。", "结论。"]
    texts += [f"第{i}次。联系人：巡检组。" for i in range(9)]
    texts += [f"副本。联系人：郝宁川。{i}" for i in range(60)]  # copies of one text do not make a team
    names = {r["value"] for r in pii.personal_spans(parts(spark, texts)).where("kind = 'name'").collect()}
    assert {*seeds, "简岚舟", "楚舟岚", "欧锦荣", "赵德", "欧阳雅婷", "郝宁川"} <= names
    assert not {x for x in names if x in ("巡检组", "结论", "提供", "邮箱", "未填写", "文件", "简岚", "岚澄")}


def test_redaction_alters_nothing_else(spark):
    texts = corpus()
    p = parts(spark, [*texts, None, "", "plain"])
    done = {r["record_id"]: r["text"] for r in pii.redacted(p, pii.personal_spans(p)).collect()}
    assert done["u0"] == "| <NAME> | <EMAIL> | <PHONE> |"
    assert done[f"u{texts.index('Ask Grynaux, Dora first.')}"] == "Ask <NAME> first."
    assert f"u{len(texts) + 2}" not in done
    by = {}
    for r in pii.personal_spans(p).collect():
        by.setdefault(r["record_id"], []).append((r["start"], r["stop"], pii.PLACEHOLDERS[r["kind"]]))
    for i, text in enumerate(texts):
        for a, b, mark in sorted(by.get(f"u{i}", []), reverse=True):
            text = text[:a] + mark + text[b:]
        assert done.get(f"u{i}", text) == text


def test_documents_are_decoded(spark):
    docs = [
        ("a", json.dumps({"k@x.example": "v", "c": {"n": ["中 a@lab.example"]}, "n": 1})),
        ("b", '{"c": "b@lab.example"}}'),
        ("c", '{"c": "cut a@lab.example", "d": ["x\\n y", "half \\u4'),
        ("d", ""),
        ("e", "null"),
    ]
    df = spark.createDataFrame(docs, "entry_id string, doc string").mapInArrow(pii._values, pii.PARTS)
    assert rows(df) == [
        ("entries", "a", "/c/n/0", "中 a@lab.example"), ("entries", "a", "/k@x.example", "v"), ("entries", "b", "/c", "b@lab.example"),
        ("entries", "c", "#1", "cut a@lab.example"), ("entries", "c", "#3", "x\n y"), ("entries", "c", "#4", "half "),
    ]


def test_defined_cases(spark):
    many = parts(spark, ["a@lab.example"]).union(parts(spark, ["a@lab.example"])).union(parts(spark, ["x " * 200_000 + "a@lab.example"]))
    assert sorted(r["start"] for r in pii.personal_spans(many).collect()) == [0, 400_000]
    none = parts(spark, ["x"]).limit(0)
    assert rows(pii.personal_spans(none)) == [] and rows(pii.redacted(none, pii.personal_spans(none))) == []


def test_check_digits():
    assert pii.resident_number("99645219911022558X") and not pii.resident_number("996452199113225580")
    assert not pii.resident_number("264540976877432198")


def test_patterns_tried_at_their_starts_find_all_matches():
    """Every pattern finds what it finds from each place of the text, whatever stands before."""
    import random

    from corpusmill.llm import pii

    bits = ["12 Main Street, Berlin 10115", "+49 (0)30 1234567", "(030) 123 4567", "AB1234567", "123-45-6789", "Lindenallee 4, 10115 Köln", "Anna Meier",
            "A1BC12345", "٣", "11010519491231002X", "7 Low Row 12345", "1", "X", "-", ".", "/", "_", "#", "+", "(", " ", "\n", "Ö", "中"]
    rng = random.Random(1)
    assert pii.STARTS
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        for pattern in (pii.PHONE, pii.ADDRESS, pii.NAME, *pii.LOOSE.values()):
            assert [m.span() for m in pii._hits(pattern, text)] == [m.span() for m in pattern.finditer(text)], text


def test_outlines_show_where_patterns_begin():
    """Nothing is tried in plain prose, and every pattern finds what it finds in the whole text."""
    import random

    bits = ["12a Heron  Way, Highmoor QZ1 6XW", "5 O’Neil \r\nRow, Ulm", "+1 (212) 555-0190", "(030) 123 4567", "030/23125-461", "X8TL04902", "AB1234567",
            "959 34 9295", "99645219911022558X", "Öhrıng 4a,\n10115 Ulm", "Grünſtraẞe 12 10115 Ä", "ANNA Ö. MÜLLER", "Grynaux, Dora", "O’Neil-Smith J. Élan",
            "4197-QX-910", "5550 19 77 123", "٣", "²", "1", "23", "X", "aB", "é", "’", "中", "-", ".", "/", "_", "#", "+", "(", " ", "\t", "\r\n", "\xa0"]
    rng = random.Random(2)
    assert {pii.RESIDENT, pii.PASSPORT, pii.SOCIAL, pii.LOOSE["address"]} <= {*pii.STARTS}
    prose = pii._outline("Of 12 runs in 2031 the First took 4 s; see Table 3 (row 17), O’Neil’s notes and 中文 A1.")
    assert not [x.pattern for _, places in pii.STARTS.values() for x in places if x.search(prose)]
    assert pii._outline("room ٣") is None
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        for pattern in pii.STARTS:
            assert [m.span() for m in pii._hits(pattern, text)] == [m.span() for m in pattern.finditer(text)], text
        j = rng.randint(1, len(text))
        m = [*pii.NEAR.finditer(text, max(0, j - 40), j)]
        assert pii._token_start(text, j) == (m[-1].start() if m and m[-1].end() == j else j), text


def test_documents_that_may_hold_chinese(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    seeds = [f"联系人：{f}{g}\n邮箱：x@lab.example" for f in "简车" for g in ("岚澄", "舟澄")]
    write("graded_units", [(f"u{i}", t) for i, t in enumerate(seeds)] + [("v", "Plain é text")], "id string, body string")
    write("findings", [(1, "今天感谢简岚舟提供的文件。"), (2, None)], "finding_id bigint, value string")
    docs = [json.dumps({"c": "今天感谢车舟岚提供的文件。"}, ensure_ascii=a) for a in (True, False)]
    docs += ['{"c": "\\u4ECA', '{"今', '{"c": "caf\\u00e9 é"}', '{"c": "plain"}', None]
    write("entries", [(f"e{i}", t) for i, t in enumerate(docs)], "entry_id string, doc string")
    every, some = pii.text_parts(spark, str(tmp_path)), pii.text_parts(spark, str(tmp_path), chinese=True)
    held = lambda df: rows(df.where(r"text rlike '[\\x{3400}-\\x{9FFF}]'"))
    assert held(some) == held(every) and len(held(some)) == 9
    assert {r["record_id"] for r in some.where("record_table = 'entries'").collect()} <= {"e0", "e1", "e2", "e3"}
    spans = pii.personal_spans(every, chinese=some)
    assert rows(spans) == rows(pii.personal_spans(every))
    assert {"简岚舟", "车舟岚"} <= {r["value"] for r in spans.where("kind = 'name'").collect()}
