"""Semantic nodes of pages: the size of the code made for them, and what they show."""

import re

from pagespark.operators import ax, dom


def test_code_made_for_a_node_is_short_enough_to_be_compiled(spark):
    """The JVM leaves methods of more than 8000 bytes to its interpreter."""
    html = ('<title>t</title><body><h2 id="x">A <b>b</b></h2><!-- c --><a href="/n" hidden>gone</a><label for="i">Age</label><input id="i" type="number" value="3" disabled>'
            '<input type="submit"><span role="switch" aria-checked="true" aria-expanded="false">on</span> </body>')
    pages = spark.createDataFrame([(1, "u", html), (None, "v", "<p>z</p>")], "page_id long, url string, html string")
    nodes = ax.ax_from_dom(dom.build_dom(pages))
    told = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(nodes._jdf.queryExecution(), "codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", told)]
    assert sizes and max(sizes) < 8000
    rows = [(r["role"], r["name"], r["p"]["value"], r["p"]["disabled"], r["p"]["checked"], r["p"]["expanded"], r["p"]["level"])
            for r in nodes.filter("snapshot_id = 1 and not ignored").orderBy("ord").collect()]
    assert ("heading", "A b", None, None, None, None, 2.0) in rows
    assert ("spinbutton", "Age", '"3"', True, None, None, None) in rows
    assert ("button", "Submit", None, None, None, None, None) in rows
    assert ("switch", "on", None, None, "true", False, None) in rows
    assert not [r for r in rows if r[0] == "link" or r[1] in ("gone", "")]
    assert sorted(r["role"] for r in nodes.filter("snapshot_id is null and not ignored").collect()) == ["RootWebArea", "StaticText", "paragraph"]
