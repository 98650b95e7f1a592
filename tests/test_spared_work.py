"""What a job doesn't ask for is not worked out, and what it asks for is the same."""

import random
import re

import pytest
from pyspark.sql import functions as F

from haetae import rules as catalog
from haetae.operators.detect import findings
from haetae.plans.process import SUMMED, Config, process
from haetae.plans.queries import QUERIES
from haetae.sinks.reports import html_fragments

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_card_pattern_is_read_in_one_way(spark):
    """Before, all ways to pair stars were tried: 13 had a match in the last of 233."""
    java = catalog.java_pattern(catalog.CARD)
    assert any(catalog.CARD in r.patterns for r in catalog.builtin()) and f"(?={catalog.THIRTEEN})" in java
    draw = random.Random(3)
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 45))) for letters in ("*", "**1", "*****4- ", "*4-", "4-9 * ", "**44-x") for _ in range(400)]
    texts += ["*" * n + x + "*" * m for n in range(0, 22, 3) for m in range(22) for x in ("-", " ", "x", "3", "--")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all("t", F.lit(java), F.lit(0)).alias("m"), F.rlike("t", F.lit(java)).alias("any"))
    for t, m, some in rows.collect():
        assert m == re.findall(catalog.CARD, t) and some == bool(m), t


def test_guards_hold_for_licences(spark):
    pattern = catalog.builtin().get("driver_license").patterns[0]
    assert catalog.pattern_guards()[pattern] == (catalog.DENSE, catalog.LICENCE)
    texts = ["서울-12-345678-90", "12 34–567890-1*", "**-**-******-**", "서울 12\t345678-90", "12-34-567890"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", findings(F.col("t"), catalog.builtin(), fields=("rule_id",)).alias("f"), F.rlike("t", F.lit(catalog.java_pattern(pattern))).alias("any"))
    for t, found, some in rows.collect():
        assert some == any(f.rule_id == "driver_license" for f in found) == bool(re.search(pattern, t)), t


@pytest.mark.parametrize("kind", ["cp949", "json", "csv", "utf16_le"])
def test_round_trips_build_no_previews(spark, kind):
    shown = plan(QUERIES[f"format_{kind}"](spark, SF))
    assert not re.search(r"context_before|masked_preview|byte_start", shown)


def test_html_reports_build_no_offsets(spark):
    shown = plan(QUERIES["html_report_rows"](spark, SF))
    assert "context_before" in shown and not re.search(r"masked_preview|byte_start", shown)


def test_fields_change_nothing_else(spark):
    texts = ["주민 900101-1234568, ****-****-****-1111\nu***@example.com 4111-1111-1111-1111", "없음", "전화 010-1234-5678\n\n계좌 110-123-456789 220-81-62517", ""]
    names = [(f"{i}.{ext}", t.encode(code)) for i, t in enumerate(texts) for ext, code in (("txt", "utf-8"), ("md", "cp949"), ("csv", "utf-8"), ("json", "utf-16"))]
    files = spark.createDataFrame(names, "filename string, content binary")
    for mode in ("full", "partial", "replace", "delete"):
        whole, brief, summed = (process(files, Config(mode=mode), again=True, fields=fields) for fields in (None, (), SUMMED))
        assert "summaries" not in brief.columns and summed.columns == whole.columns
        same = [c for c in brief.columns if c != "findings"]
        assert sorted(map(str, whole.select(*same).collect())) == sorted(map(str, brief.select(*same).collect()))
        same = [c for c in summed.columns if c != "findings"]
        assert sorted(map(str, whole.select(*same).collect())) == sorted(map(str, summed.select(*same).collect()))
        assert sorted(map(str, html_fragments(whole).collect())) == sorted(map(str, html_fragments(summed).collect()))
        kept = lambda f: F.struct(*[f[n].alias(n) for n in ("rule_id", "raw", "confidence", "paragraph_index", "char_start", "char_end")])
        assert sorted(map(str, whole.select("filename", F.transform("findings", kept).alias("findings")).collect())) == sorted(map(str, brief.select("filename", "findings").collect()))


def test_a_compound_file_is_opened_once_and_records_read_whole(monkeypatch):
    from haetae.plans.formats import hwp5
    from haetae.sources import files, hwp

    opened, real = [], hwp.CompoundFile
    monkeypatch.setattr(hwp, "CompoundFile", lambda data: opened.append(1) or real(data))
    data = hwp5([f"줄 {i} 010-1234-56{i:02}" for i in range(12)])
    texts = files.extract("a.hwp", data)["paragraphs"]
    assert len(texts) == 12 and len(opened) == 1
    masked = [t.replace("1234", "****") for t in texts]
    done = files.rewrite("a.hwp", data, "hwp", None, masked, None, None)
    assert files.extract("a.hwp", done["content"])["paragraphs"] == masked and done["note"] is None
    spans = [{"paragraph_index": 0, "char_start": 0, "char_end": 1, "replacement": "*"}]
    assert files.rewrite("a.txt", "가나".encode("cp949"), "txt", "euc_kr", None, spans, [0])["content"] == "*나".encode("cp949")
    draw, records = random.Random(9), []
    for kind in ([*range(33), 0x41, 0xAC00, 0xFEFF, 0xD83D, 0xDE00], [0x41, 0xAC00, 0x2A]):
        for _ in range(2000):
            units = draw.choices(kind, k=draw.randint(0, 14)) + draw.choice([[], [13], [13, 0]])
            records.append(b"".join(u.to_bytes(2, "little") for u in units) + draw.choice([b"", b"", b"x"]))
    news = ["".join(draw.choice([c, c, "*", "", "😀", "한"]) for c in hwp.paragraph_text(r)) for r in records]
    fast = [(hwp.paragraph_text(r), hwp.replace_text(r, t)) for r, t in zip(records, news)]
    monkeypatch.setattr(hwp, "_characters", lambda record: None)
    assert fast == [(hwp.paragraph_text(r), hwp.replace_text(r, t)) for r, t in zip(records, news)]


def test_plain_archives_need_no_library(monkeypatch):
    """Plain archives are rewritten without the zip library, byte by byte as it does; what is odd about one is left to it."""
    import io
    import zipfile

    from haetae.plans.formats import docx
    from haetae.sources import containers, files

    draw = random.Random(11)
    names = ["mimetype", "word/document.xml", "가/나.xml", "a\\b.xml", "dir/", "é.xml", "docProps/core.xml"]
    seen = lambda listed: listed and [(i.filename, i.orig_filename, i.flag_bits, i.compress_type, i.CRC, i.compress_size, i.file_size, i.header_offset) for i in listed]

    def outcome(make, *values):
        try:
            return make(*values)
        except Exception as error:  # noqa: BLE001
            return type(error), str(error)

    kept, plain = [], containers._plain_directory
    for _ in range(1500):
        parts = [(name, bytes(draw.choices(b"<a>b &", k=draw.choice([0, 1, 300])))) for name in draw.sample(names, draw.randint(0, 5))]
        made = containers.write_parts(parts)
        monkeypatch.setattr(containers, "_SMALL", 0)
        assert made == containers.write_parts(parts)
        monkeypatch.setattr(containers, "_SMALL", 1 << 30)
        data = bytearray(made)
        for _ in range(draw.choice([0, 1, 2])):
            data[draw.choice([draw.randrange(len(data)), max(0, len(data) - draw.randint(1, 120))])] = draw.choice([0, 1, 255])
        data = draw.choice([b"", b"", b"x"]) + bytes(data) + draw.choice([b"", b"", b"x"])
        kept.append((data, outcome(containers.read_parts, data), plain(data)))
    monkeypatch.setattr(containers, "_plain_directory", lambda data: None)
    assert all(parts == outcome(containers.read_parts, data) and (listed is None or seen(listed) == seen(containers.directory(data))) for data, parts, listed in kept)
    assert 300 < sum(listed is not None for _, _, listed in kept) < 1200
    noted = io.BytesIO()
    with zipfile.ZipFile(noted, "w") as archive:
        archive.writestr("a", "b")
        archive.comment = b"PK"
    assert plain(noted.getvalue()) is None and containers.read_parts(noted.getvalue()) == [("a", b"b")]
    monkeypatch.setattr(containers, "_plain_directory", plain)
    data = docx([f"줄 {i}" for i in range(12)])
    texts = files.extract("a.docx", data)["paragraphs"]
    masked = [t.replace("줄", "*") for t in texts]
    with monkeypatch.context() as without:
        without.setattr(zipfile, "ZipFile", None)
        done = files.rewrite("a.docx", data, "docx", None, masked, None, None)
    assert texts[0] == "줄 0" and done["note"] is None and files.extract("a.docx", done["content"])["paragraphs"] == masked


def test_arrays_by_field_are_those_of_rows(spark):
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    from haetae.operators import arrow
    from haetae.sources.files import EXTRACTED

    kind = to_arrow_type(T.StructType(list(T._parse_datatype_string(EXTRACTED))))
    one = {"format": "x", "paragraphs": ["a", None, "가"], "places": [], "offsets": [1, 2], "warnings": None, "more": 1}
    for rows in ([], [None], [one, None, {}, {**one, "error": "e"}], [one, one]):
        made = arrow._array(rows, kind)
        made.validate(full=True)
        assert made.type == kind and made.null_count == rows.count(None) and made.to_pylist() == pa.array(rows, kind).to_pylist()
    assert arrow._size({"a": ["x", "yy"], "b": [b"1", None], "c": [1, 2], "d": "q", "e": [{"z": "zz"}]}) == 3 + 9 + 16 + 1 + 2
