from lectern.operators import cleaning


def cleaned(spark, *pages):
    rows = [("d", i + 1, f"d:{i + 1}", t, "f.pdf") for i, t in enumerate(pages)]
    df = spark.createDataFrame(rows, "document_key string, page_number int, page_id string, text string, file_name string")
    return cleaning.clean_pages(df).orderBy("page_number").collect()


def test_repeated_footers_go_and_prose_is_joined(spark):
    out = cleaned(spark, *[f"Intro {x} begins here\nand goes on for {x} whiles.\n\nMiddle words {x}.\nAlways The Same\nPage {x} of 3" for x in (1, 2, 3)])
    assert all(r.removed_margin_line_count == 2 for r in out)
    assert out[0].text == "Intro 1 begins here and goes on for 1 whiles.\n\nMiddle words 1."
    assert out[0].source_file_name == "f.pdf" and out[0].text_cleaned


def test_hyphens(spark):
    assert cleaned(spark, "a hyphen-\nated word and well-\nKnown")[0].text == "a hyphenated word and well- Known"


def test_lists_keep_one_line_per_item(spark):
    assert cleaned(spark, "- first item\n  goes on\n- second item")[0].text == "- first item goes on\n- second item"
    assert cleaned(spark, "• one\n◦ two\n▪ three\n● four")[0].text == "• one\n◦ two\n▪ three\n● four"


def test_child_headings_stay_though_they_repeat(spark):
    out = cleaned(spark, *[f"Concept\nText number {x} is prose." for x in ("a", "b", "c")])
    assert all(r.text.startswith("Concept\n\n") for r in out)


def test_bare_page_numbers_go(spark):
    assert [r.text for r in cleaned(spark, "Some text here.\n\n1", "Other text there.\n\n- 2 -")] == ["Some text here.", "Other text there."]


def test_headings_part_blocks(spark):
    assert cleaned(spark, "words before\n2.1 Hash Maps\nwords after")[0].text == "words before\n\n2.1 Hash Maps\n\nwords after"


def test_code_keeps_its_depth_over_blank_lines(spark):
    out = cleaned(spark, "public class A {\nprivate int x;\n\npublic int get() {\nreturn x;\n}\n}")[0].text
    assert out == "public class A {\n    private int x;\n\n    public int get() {\n        return x;\n    }\n}"


def test_indentation_steps_without_braces():
    assert cleaning.indent_by_steps(["  a();", "    b();", "      c();"], 0) == ["a();", "    b();", "        c();"]


def test_semicolon_prose_is_not_code(spark):
    assert cleaned(spark, "This is a sentence that ends oddly;\nand goes on.")[0].text == "This is a sentence that ends oddly; and goes on."


def test_quotes_hide_braces():
    assert cleaning.balance("s = \"{{\" + '}' ; {", "{", "}") == 1
    assert cleaning.balance(r"c = '\'' ; {", "{", "}") == 1


def test_nulls_empty_and_composition(spark):
    out = cleaned(spark, None, "", "ﬁne text\r\nmore")
    assert [r.text for r in out] == ["", "", "fine text more"]
    assert out[0].source_original_character_count == 0


def test_empty_table(spark):
    assert cleaned(spark) == []


def test_two_forms_of_the_pattern_of_calls_agree():
    """The pattern without nested repeats matches what the plain form does, on made lines of its own characters."""
    import random
    import re

    from lectern.functions import patterns as P

    plain = re.compile(r"^(?:(?:[\w.$<>?\[\],]+\s+)+\w+\s*=.+;|[\w.$]+\s*\([^;]*\);)$", re.ASCII)
    own = re.compile(P.CODE_CALL, re.ASCII)
    rng = random.Random(3)
    parts = ["int", "x", "List<String>", "a.b", "$v", "=", " ", "  ", ";", "(", ")", "[0]", ",", "?", "y1", "==", "-", "\t"]
    lines = {"".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) + rng.choice(["", ";", ");"]) for _ in range(60_000)}
    found = [bool(plain.match(x)) for x in lines]
    assert [bool(own.match(x)) for x in lines] == found and 300 < sum(found) < len(lines) / 2


def test_plain_lines_stay_and_others_are_normalized_as_before(spark):
    import random

    from pyspark.sql import functions as F

    from lectern.functions import patterns as P, text as T

    r = random.Random(9)
    lines = ["".join(r.choices("ab,é \t\x0b\u3000\x85\u2028\u2029\xa0", (9, 9, 3, 3, 6, 1, 1, 1, 1, 1, 1, 1), k=r.randrange(14))) for _ in range(4000)] + ["", " ", "a b", "a  b", " a", "a ", "\ta"]
    bare = F.regexp_replace("l", r"\s+$", "")
    lead = F.regexp_extract(bare, r"^(\s*)", 1)
    content = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^\s+", ""), P.HORIZONTAL_SPACE, " "), r"\s+$", "")
    every = F.when(content == "", "").otherwise(F.concat(F.repeat(F.lit(" "), F.least(F.length(lead) + T.count_of(lead, "\t") * 3, F.lit(P.MAX_INDENT))), content))
    rows = spark.createDataFrame([(x,) for x in lines], "l string").select("l", T.normalize_line(F.col("l")).alias("own"), every.alias("every"))
    assert rows.filter("own != every").count() == 0 and rows.filter(F.col("l").rlike(P.NORMAL_LINE)).count() > 500


def test_queries_bound_what_a_python_worker_is_given(spark, sf):
    from lectern.plans import registry

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    registry.QUERIES["clean_pages"](spark, sf)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
