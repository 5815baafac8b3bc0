"""Formats, containers, imports and parts that can be replaced, on small files."""

import random

import pytest


def test_markup_tokens_and_problems():
    from glyphflow.sources.markup import tokens

    assert tokens(r"a\[b\] [i]c[/i]\\") == ([("text", "a[b] "), ("open", ("italic", "")), ("text", "c"), ("close", "italic"), ("text", "\\")], [])
    assert tokens("[zz]x[m0][m2]") == ([("text", "[zz]x[m0]"), ("open", ("sense", "2"))], [("unknown", "zz"), ("unknown", "m0")])
    assert tokens(r"a[b\]c") == ([("text", r"a[b\]c")], [("unterminated", r"[b\]c")])
    assert tokens("[c red]x[/c][b y][/m]")[0] == [("open", ("colour", "red")), ("text", "x"), ("close", "colour"), ("text", "[b y]"), ("close", "sense")] and tokens("\\") == ([("text", "\\")], [])


def test_senses_nest_by_level():
    from glyphflow.sources.markup import readings, senses

    found, wrong = senses(["[m1]one[/m]", "[m3]deep[/m][m2]mid[/m][m3]deep too[/m]", "[p]гл.[/p][p]разг.[/p]"])
    assert [(x["level"], x["parent"], x["text"]) for x in found] == [(0, None, "one"), (2, 0, "deep"), (1, 0, "mid"), (2, 2, "deep too")] and not wrong
    assert found[-1]["pos"] == ["гл."] and found[-1]["registers"] == ["разг."]
    assert senses([])[0] == [] and senses(["plain", "text"])[0][0]["text"] == "plain text"
    assert senses(["[ex]你好 。 hi 好[/ex]"])[0][0]["examples"] == [{"chinese": "你好 。", "translation": "hi 好", "raw": "你好 。 hi 好"}]
    assert readings("[b]ni hao[/b], рус lǎo; 12") == ["ni hao", "lǎo"] and readings(None) == []


def test_codec_round_trip_and_cut_payloads():
    from glyphflow.sources.codec import pack, unpack

    r = random.Random(3)
    for _ in range(300):
        senses = [{"id": r.choice((k, k + 300)), "kind": r.choice(("definition", "reference", "label")), "text": r.choice(("", "x", "中文" * 90)), "level": r.choice((0, 1, 200))} for k in range(r.randrange(5))]
        data = pack(senses)
        assert unpack(data) == senses
        for cut in range(len(data)):
            with pytest.raises(ValueError):
                unpack(data[:cut])
    with pytest.raises(ValueError):
        unpack(b"\x02\x00")


def test_byte_lines_resume_at_offsets():
    from glyphflow.sources.encodings import byte_lines, forced, previews, sniff

    text = "一\r\nab\n\n𠀀"
    for data, encoding in ((text.encode(), "utf-8"), (b"\xff\xfe" + text.encode("utf-16-le"), "utf-16-le"), ("abc\ndef".encode("utf-16-be"), "utf-16-be")):
        assert sniff(data) == encoding
        rows = byte_lines(data)
        assert [x for _, x in rows] == (["一", "ab", "", "𠀀"] if "一" in data.decode(encoding) else ["abc", "def"])
        for k, (at, _) in enumerate(rows):
            assert byte_lines(data, at) == rows[k:]
    with pytest.raises(ValueError):
        byte_lines(b"\xff\xfea\0", 1)
    assert byte_lines(b"\xff\xfe\x00\xd8") == [(2, "�")]
    assert forced(b"\xff", "utf-8") is None and forced("中".encode("big5"), "big5") == "中"
    assert {e for e, *_ in previews("中文".encode("gb18030") * 5000)} >= {"gb18030"}


def test_file_sets():
    from glyphflow.sources.files import file_set

    there = {"/d/a01.dsl", "/d/a02.dsl", "/d/a04.dsl", "/d/x.dsl", "/d/y.dsl", "/d/z.dsl"}
    heads = {"/d/x.dsl": ["y.dsl", "none.dsl"], "/d/y.dsl": ["x.dsl", "z.dsl"]}
    get = lambda p: heads.get(p, [])
    assert file_set("/d/a02.dsl", there.__contains__, get) == (["/d/a01.dsl", "/d/a02.dsl"], "numbered", [])
    assert file_set("/d/a04.dsl", there.__contains__, get) == (["/d/a04.dsl"], "single", [])
    assert file_set("/d/x.dsl", there.__contains__, get) == (["/d/x.dsl", "/d/y.dsl", "/d/z.dsl"], "includes", [("missingInclude", "none.dsl")])


def test_compile_replaces_the_container_as_a_whole(spark, tmp_path):
    from glyphflow.compile import compile_cards, compile_cedict
    from glyphflow.sources import container

    src, out = tmp_path / "d.u8", str(tmp_path / "dict")
    src.write_text("# c\n#! entries=2\n你好 你好 [ni3 hao3] /hello/hi/\n國 国 [Guo2] /country/\n")
    assert all(r.ok for r in compile_cedict(spark, str(src), out, least=2).collect())
    assert {r.word for r in container.read(spark, out, "lexeme").collect()} == {"你好", "國", "国"}
    src.write_text("bad\n")
    with pytest.raises(ValueError):
        compile_cedict(spark, str(src), out)
    src.write_text("a b [c1] /d/\n")
    with pytest.raises(ValueError):
        compile_cedict(spark, str(src), out, least=5)
    assert container.read(spark, out, "entry").count() == 2 and container.free_name(spark, out) == out + "-2"
    container.rebuild(spark, out)
    assert {r.character: r.numeric for r in container.read(spark, out, "char_reading").collect()} == {"国": "Guo2"}
    card = tmp_path / "c.dsl"
    card.write_bytes(b"\xff\xfe" + "#NAME \"x\"\n一\n\tyi\n\t[m1]one[/m]\n".encode("utf-16-le"))
    assert all(r.ok for r in compile_cards(spark, str(card), str(tmp_path / "cards")).collect())
    (tmp_path / "broken").mkdir()
    got = {(r.name, r.key) for r in container.catalogue(spark, str(tmp_path)).where("name in ('broken', 'dict')").collect()}
    assert ("broken", "unreadable") in got and ("dict", "entryCount") in got


def test_byte_line_source_reads_each_line_once(spark, tmp_path):
    from glyphflow import plugins

    data = "".join(f"строка {k}\r\n" if k % 3 else "\n" for k in range(200))
    (tmp_path / "f").write_text(data, newline="")
    spark.dataSource.register(plugins.take("bytes", "byte_lines"))
    for size in (1, 7, 64, 10_000):
        rows = sorted(spark.read.format("byte_lines").option("path", str(tmp_path / "f")).option("rangeBytes", size if size > 1 else 37).load().collect())
        assert [r.line for r in rows] == [x.rstrip("\r") for x in data.split("\n")[:-1]]
        assert all(data.encode()[r.offset :].startswith(r.line.encode()) for r in rows)


def test_parts_are_taken_by_name_and_caches_are_bounded():
    from glyphflow import plugins

    plugins.register("splitter", "pairs", lambda s: [s[k : k + 2] for k in range(0, len(s), 2)])
    assert plugins.take("splitter", "pairs")("一二三") == ["一二", "三"] and plugins.take("splitter", "characters")("一二") == ["一", "二"]
    with pytest.raises(KeyError):
        plugins.take("splitter", "none")
    with pytest.raises(ValueError):
        plugins.register("none", "x", 1)
    asked, cache = [], plugins.BoundedCache(2)
    for k in (1, 2, 1, 3, 1, 2):
        cache.get(k, lambda x: asked.append(x))
    assert asked == [1, 2, 3, 2]


def test_import_reports_and_resumes(spark, tmp_path):
    from glyphflow.streaming.imports import Progress, Throttle, import_lines, lexemes_of, rolled_back

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.u8").write_text("# x\n你好 你好 [ni3 hao3] /hello/\nbad\n国 国 [guo2] /a/b/\n")
    seen = []
    listener = Progress(seen.append)
    spark.streams.addListener(listener)
    args = [str(tmp_path / x) for x in ("in", "out", "cp", "bad")]
    import_lines(spark, *args).awaitTermination()
    spark.streams.removeListener(listener)
    assert sorted((r.line_no, r.simplified) for r in spark.read.parquet(args[1]).collect()) == [(2, "你好"), (4, "国")]
    assert [(r.line_no, r.error) for r in spark.read.parquet(args[3]).collect()] == [(3, "tooFewFields")]
    assert {r.word: r.weight for r in lexemes_of(spark.read.parquet(args[1])).collect()} == {"你好": 0.625, "国": 1.25}
    now, out = [0.0], []
    t = Throttle(out.append, 0.1, lambda: now[0])
    for k in range(10):
        t(k)
        now[0] += 0.04
    t("end", final=True)
    assert out == [0, 3, 6, 9, "end"]
    rows = spark.createDataFrame([(0, 5), (1, 2), (1, 9)], "source_file int, source_offset int")
    job = {"fingerprint": "f", "parser_version": 1, "file": 1, "offset": 9}
    assert rolled_back(rows, job, "f", 1).count() == 2 and rolled_back(rows, job, "g", 1).count() == 0 and rolled_back(rows, None, "f", 1).count() == 0


def test_pinyin_marks_and_syllables(spark):
    from pyspark.sql import functions as F

    from glyphflow.functions import pinyin as P

    cases = {"Er2": "Ér", "Ou1": "Ōu", "m2": "ḿ", "ng4": "ng̀", "lu:4": "lǜ", "nv3": "nǚ", "r5": "r", "xiu1": "xiū", "hui4": "huì", "Ai4": "Ài", "hm1": "hm̄"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.m for r in df.select("s", P.marked(F.col("s")).alias("m")).collect()} == cases
    bases = {"xi", "an", "xian", "nü", "er", "fang", "fan", "ga", "gan"}
    assert P.syllables("Xī'ān", bases) == [("Xi", 1), ("an", 1)] and P.syllables("xiān", bases) == [("xian", 1)]
    assert P.syllables("fangan", bases) == [("fang", 5), ("an", 5)] and P.syllables("fāngàn", {"fan", "gan"}) == [("fan", 1), ("gan", 4)]
    assert P.syllables("xyz", bases) is None and P.syllables("", bases) is None and P.from_marked("1") is None
