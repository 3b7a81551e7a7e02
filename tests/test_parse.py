import pytest

from tidewatch.errors import UnregisteredFormatError
from tidewatch.operators import parse

NS = parse.EVENT_XML_NAMESPACE


def raws(df):
    rows = df.orderBy("file_path", "block_start", "seq").select("raw", "is_parsed").collect()
    assert all((r.raw is not None) == r.is_parsed for r in rows)
    return [None if r.raw is None else dict(r.raw) if isinstance(r.raw, dict) else r.raw.asDict() for r in rows]


def test_syslog(make_lines):
    got = raws(
        parse.parse_syslog(
            make_lines(
                [
                    "<34>Jan  5 06:00:00 mymachine su[12]: 'su root' failed",
                    "  Feb 14 06:00:00 h cron : x: y  ",
                    "Jan 5 06:00:00 h p:",
                    "no syslog",
                    "",
                    None,
                ]
            )
        )
    )
    assert got[0] == {
        "priority": "34", "month": "Jan", "day": "5", "time": "06:00:00", "hostname": "mymachine",
        "process": "su", "pid": "12", "message": "'su root' failed",
    }
    assert got[1]["priority"] is None and got[1]["pid"] is None
    assert got[1]["process"] == "cron" and got[1]["message"] == "x: y"
    assert got[2:] == [None] * 4


def test_apache(make_lines):
    got = raws(
        parse.parse_apache(
            make_lines(
                [
                    '127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 2326 "http://r/" "Mozilla/4.08 [en]"',
                    '127.0.0.1 - - [10/Oct/2000:13:55:36 -0700] "POST /login HTTP/1.1" 401 -',
                    '1.1.1.1 - - [t] "" 200 5 "" "-"',
                    '1.1.1.1 - - [t\x01] "GET  b c d" 200 5',
                    "127.0.0.1",
                    "a\x01b\x01c\x01d\x01e\x01f\x01g\x01h\x01i",
                ]
            )
        )
    )
    assert got[0]["referer"] == "http://r/" and got[0]["user_agent"] == "Mozilla/4.08 [en]"
    assert (got[0]["method"], got[0]["uri"], got[0]["protocol"]) == ("GET", "/a", "HTTP/1.0")
    assert got[1]["user"] is None and got[1]["bytes"] is None and got[1]["referer"] is None
    assert got[2]["method"] is None and got[2]["uri"] is None
    assert got[2]["referer"] == "" and got[2]["user_agent"] is None
    assert got[3]["time"] == "t\x01" and got[3]["uri"] == "" and got[3]["protocol"] == "b c d"
    assert got[4:] == [None, None]


def test_zeek_default_and_given_columns(make_lines):
    line = "\t".join(["1609459200.0", "C1", "1.1.1.1", "80"] + ["-"] * 16 + ["x"])
    got = raws(parse.parse_zeek(make_lines([line, "#comment", "a\tb", ""])))
    assert got[0]["ts"] == "1609459200.0" and got[0]["id.resp_h"] is None and len(got[0]) == 21
    assert got[1:] == [None, None, None]
    assert raws(parse.parse_zeek(make_lines(["1\t-"]), fields=["a", "b"])) == [{"a": "1", "b": None}]


def test_zeek_one_header_everywhere(make_lines):
    got = raws(parse.parse_zeek(make_lines(["#fields\ta\tb\tc", "1\t-\t3", "1\t2"])))
    assert got == [None, {"a": "1", "b": None, "c": "3"}, None]


def test_zeek_header_changes_inside_a_block_and_carries_over(make_lines):
    lines = make_lines(["#fields\ta\tb", "1\t2", "#fields\tb\ta", "3\t4"]).unionByName(
        make_lines(["5\t6", "#fields\tx", "7"], block=10)
    ).unionByName(make_lines(["8"], block=20)).unionByName(make_lines(["#fields\tq", "9"], file="g"))
    got = [r for r in raws(parse.parse_zeek(lines)) if r]
    assert got == [{"a": "1", "b": "2"}, {"b": "3", "a": "4"}, {"b": "5", "a": "6"}, {"x": "7"}, {"x": "8"}, {"q": "9"}]


def test_zeek_repeated_column_keeps_the_last_value(make_lines):
    lines = make_lines(["#fields\ta\ta", "1\t2", "#fields\tb\tc", "3\t-"])
    assert [r for r in raws(parse.parse_zeek(lines)) if r] == [{"a": "2"}, {"b": "3", "c": None}]
    assert raws(parse.parse_zeek(make_lines(["1\t2"]), fields=["a", "a"])) == [{"a": "2"}]


def test_event_xml(make_lines):
    full = (
        f'<Event xmlns="{NS}"><System><EventID Qualifiers="1">4624</EventID><TimeCreated SystemTime="2026-01-01T00:00:00Z"/>'
        "<Computer>W</Computer><Channel>Security</Channel></System><EventData><Data Name=\"SubjectUserName\">alice</Data>"
        '<Data Name="LogonType">3</Data><Data>unnamed</Data><Data Name="LogonType">4</Data></EventData></Event>'
    )
    prefixed = f'<e:Event xmlns:e="{NS}"><e:System><e:EventID>7</e:EventID></e:System></e:Event>'
    bad = [
        "<not valid xml",
        f'<Event xmlns="{NS}"><NoSystem/></Event>',
        f'<Event xmlns="{NS}"><System><Other/></System></Event>',
        "<Event><System><EventID>1</EventID></System></Event>",
        "",
    ]
    got = raws(parse.parse_evtx(make_lines([full, prefixed, *bad])))
    assert got[0] == {
        "EventID": "4624", "TimeCreated": "2026-01-01T00:00:00Z", "Computer": "W", "Channel": "Security",
        "SubjectUserName": "alice", "LogonType": "4",
    }
    assert got[1] == {"EventID": "7", "TimeCreated": None, "Computer": None, "Channel": None}
    assert got[2:] == [None] * len(bad)


def test_split_adds_up_and_unknown_format(make_lines):
    lines = make_lines(["Jan 5 06:00:00 h p: m", "bad", ""])
    good, failed = parse.split_parsed(parse.parse(lines, "syslog"))
    assert (good.count(), failed.count()) == (1, 2)
    with pytest.raises(UnregisteredFormatError):
        parse.parse(lines, "nope")


def test_zeek_files_do_not_depend_on_how_the_input_is_split(spark, tmp_path):
    """Two layouts, one of them changing within a file; the second read has other splits than the first pass."""
    from tidewatch.sources.lines import read_lines

    def block(fields, values):
        return ["#fields\t" + "\t".join(fields)] + ["\t".join(v) for v in values]

    rows = [(f"u{i}", str(i)) for i in range(4000)]
    (tmp_path / "a.log").write_text("\n".join(block(["uid", "n"], rows[:2000])) + "\n")
    late = block(["n", "uid"], [(n, u) for u, n in rows[2000:3000]]) + block(["uid", "n"], rows[3000:])
    (tmp_path / "b.log").write_text("\n".join(late) + "\n")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for first, second in (("1000000", "4000"), ("4000", "1000000"), ("5000", "7000")):
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            spark.conf.set("spark.sql.files.maxPartitionBytes", first)
            parsed = parse.parse_zeek(read_lines(spark, str(tmp_path)))
            spark.conf.set("spark.sql.files.maxPartitionBytes", second)
            got = sorted((r.raw["uid"], r.raw["n"]) for r in parsed.where("is_parsed").collect())
            assert got == sorted(rows)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def test_zeek_line_of_an_unseen_file_is_an_error(make_lines, monkeypatch):
    lines = make_lines(["#fields\ta\tb", "1\t2"])
    for name in "gh":
        lines = lines.unionByName(make_lines([f"#fields\tb\t{name}", "1\t2"], file=name))
    layouts = parse._zeek_file_layouts
    monkeypatch.setattr(parse, "_zeek_file_layouts", lambda blocks: layouts(blocks).where("file_path <> 'h'"))
    with pytest.raises(Exception, match="no column list"):
        parse.parse_zeek(lines).collect()
