"""Functions by their names in SQL text."""

import os

from searchlake.catalog import all_queries
from searchlake.functions.sqlnames import register

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_name_is_called(spark):
    names = register(spark)
    row = spark.sql("""select crawl_key('https://A.org/x/#y') as crawl_key, result_domain('https://B.org:80/x') as result_domain, word_list('One, two') as word_list, snippet_of(repeat('é', 400)) as snippet_of,
        spoken_digits('four hundred boots') as spoken_digits, written_operators('boots under 400') as written_operators, sound_code('knight') as sound_code, (select count(*) from expand_query('react vs vue', 'comparison')) as expand_query""").first()
    assert set(names) == set(row.asDict())
    assert (row.crawl_key, row.result_domain, row.word_list, len(row.snippet_of)) == ("https://a.org/x", "b.org", ["one", "two"], 400)
    assert (row.spoken_digits, row.written_operators, row.sound_code) == ("400 boots", "boots price:<400", "NT") and row.expand_query > 1


def test_the_table_function_gives_the_rows_of_the_query(spark):
    rows = lambda name: sorted(map(tuple, all_queries()[name](spark, SF).select("text", "intent", "pos", "variant").collect()))
    assert rows("sql_expansions") == rows("expand_query")
