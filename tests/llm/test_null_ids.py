import uuid

from meshwork.llm.common import shared_folder
from meshwork.llm.token_counts import TokenRollup

SCHEMA = "doc_id long, text string, lang string, source string"


def test_a_null_id_names_no_document(spark):
    rollup = TokenRollup(spark, f"{shared_folder(spark)}/test-{uuid.uuid4().hex}", {"words-1": None})
    row = lambda text: spark.createDataFrame([(None, text, "en", "s")], SCHEMA)
    totals = lambda: [(r.docs, r.tokens) for r in rollup.totals().collect()]
    rollup.commit("a", inserts=row("a b c"))
    rollup.commit("b", deletes=spark.createDataFrame([(None,)], "doc_id long"))
    assert totals() == [(1, 3)]
    rollup.commit("c", revisions=row("d e"))
    assert totals() == [(2, 5)]
