"""Text search, CSS paths and locators over node arrays (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.css import css_flags
from ..functions.lets import let
from ..functions.prefix import running_max
from ..functions.text import squash, trim_all
from .dom import attr


def _id_text(ident: Column) -> Column:
    """An id escaped for CSS."""
    escaped = F.regexp_replace(ident, "([^A-Za-z0-9_\\-\\u0080-\\uffff])", "\\\\$1")
    return F.regexp_replace(escaped, "^([0-9])", "\\\\3$1 ")


def css_path_of(nodes: Column, n: Column) -> Column:
    """At most five levels up from an element, stopping at the first one with an id."""

    def label(e: Column) -> Column:
        ident = attr(e, "id")
        nth = F.when(e["nth_n"] > 1, F.concat(F.lit(":nth-of-type("), e["nth"].cast("string"), F.lit(")"))).otherwise("")
        has_id = F.length(F.coalesce(ident, F.lit(""))) > 0
        return F.struct(
            has_id.alias("stop"),
            F.concat(e["tag"], F.when(has_id, F.concat(F.lit("#"), _id_text(ident))).otherwise(nth)).alias("text"),
        )

    def cut(labels: Column) -> Column:
        stop_at = F.array_position(F.transform(labels, lambda x: x["stop"]), True)
        kept = F.when(stop_at > 0, F.slice(labels, 1, stop_at.cast("int"))).otherwise(labels)
        return F.array_join(F.reverse(F.transform(kept, lambda x: x["text"])), " > ")

    up = lambda e: F.get(nodes, e["parent"])
    chain = let(n, lambda a: let(up(a), lambda b: let(up(b), lambda c: let(up(c), lambda d: F.array(a, b, c, d, up(d))))))
    return let(F.transform(F.array_compact(chain), label), cut)


def css_path(dom: DataFrame) -> DataFrame:
    """CSS path of every element below the body."""
    labelled = F.transform(
        F.filter("nodes", lambda n: (n["kind"] == "element") & (n["depth"] >= 2)),
        lambda n: F.struct(n["ord"].alias("ord"), n["tag"].alias("tag"), css_path_of(F.col("nodes"), n).alias("selector")),
    )
    return dom.select("page_id", F.explode(labelled).alias("e")).select("page_id", "e.*")


def find_text(dom: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Case-insensitive search in the body's text nodes: one hit per node, in document order.

    Output: page_id, hit (1-based), tag, snippet (40 characters around the first occurrence), selector.
    """
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    q = query.lower()
    nodes = F.col("nodes")
    body = F.get(F.filter(nodes, lambda n: n["tag"] == "body"), F.lit(0))
    in_body = let(body, lambda b: F.filter(F.slice(nodes, b["ord"] + 1, b["last"] - b["ord"] + 1), lambda n: n["kind"] == "text"))
    trimmed = F.transform(in_body, lambda n: F.struct(n["parent"].alias("parent"), trim_all(n["text"]).alias("t")))
    hits = F.slice(
        F.filter(trimmed, lambda h: (F.length(h["t"]) >= 2) & F.lower(h["t"]).contains(q)), 1, limit)

    def shown(h: Column) -> Column:
        at = F.call_function("instr", F.lower(h["t"]), F.lit(q)) - 1
        start = F.greatest(F.lit(0), at - 40)
        end = F.least(F.length(h["t"]), at + len(q) + 40)
        snippet = F.concat(
            F.when(start > 0, "...").otherwise(""), F.substring(h["t"], start + 1, end - start),
            F.when(end < F.length(h["t"]), "...").otherwise(""),
        )
        el = F.get(nodes, h["parent"])
        return F.struct(el["tag"].alias("tag"), snippet.alias("snippet"), css_path_of(nodes, el).alias("selector"))

    return dom.select("page_id", F.posexplode(F.transform(hits, shown)).alias("pos", "h")).select(
        "page_id", (F.col("pos") + 1).alias("hit"), "h.tag", "h.snippet", "h.selector")


# --- locators ---

def text_of(nodes: Column, n: Column) -> Column:
    """Squeezed text of an element's sub-tree (scripts and styles left out)."""
    below = F.slice(nodes, n["ord"] + 1, n["last"] - n["ord"] + 1)
    seen = F.filter(below, lambda x: (x["kind"] == "text") & ~F.get(nodes, x["parent"])["tag"].isin("script", "style", "noscript", "template"))
    return squash(F.array_join(F.transform(seen, lambda x: x["text"]), ""))


# Implicit roles by tag.
TAG_ROLES = """
a link / article article / aside complementary / blockquote blockquote / button button / caption caption /
code code / dd definition / dialog dialog / dt term / em emphasis / fieldset group / figure figure / footer contentinfo /
form form / h1 heading / h2 heading / h3 heading / h4 heading / h5 heading / h6 heading / header banner / hr separator /
img img / label LabelText / li listitem / main main / menu list / meter meter / nav navigation / ol list / option option / p paragraph /
progress progressbar / search search / select combobox / strong strong / sub subscript / sup superscript / table table /
tbody rowgroup / td cell / textarea textbox / tfoot rowgroup / th columnheader / thead rowgroup / time time / tr row / ul list
"""
# Roles of input elements by type.
INPUT_ROLES = """
text textbox / email textbox / tel textbox / url textbox / password textbox / search searchbox / number spinbutton /
range slider / checkbox checkbox / radio radio / button button / submit button / reset button / image button
"""
NAMED_BY_CONTENT = "link button heading option tab menuitem menuitemcheckbox menuitemradio treeitem columnheader rowheader switch checkbox radio".split()
LABELLED_TAGS = "input select textarea button meter progress output".split()


def _pairs(text: str) -> dict[str, str]:
    return dict(p.split() for p in text.replace("\n", " ").split("/") if p.strip())


def role_of(n: Column) -> Column:
    """ARIA role of an element: its role attribute, else by tag (and type); null when it has none."""
    given = F.nullif(F.get(F.split(F.trim(F.coalesce(attr(n, "role"), F.lit(""))), "\\s+"), F.lit(0)), F.lit(""))
    tag = n["tag"]
    table = F.create_map(*[F.lit(x) for kv in _pairs(TAG_ROLES).items() for x in kv])
    inputs = F.create_map(*[F.lit(x) for kv in _pairs(INPUT_ROLES).items() for x in kv])
    typed = F.lower(F.coalesce(F.nullif(attr(n, "type"), F.lit("")), F.lit("text")))
    by_tag = (
        F.when(tag == "input", F.when(typed == "hidden", F.lit(None)).otherwise(
            F.coalesce(F.try_element_at(inputs, typed), F.lit("textbox"))))
        .when(tag == "a", F.when(attr(n, "href").isNotNull(), "link"))
        .when((tag == "select") & attr(n, "multiple").isNotNull(), "listbox")
        .when(tag == "section", F.when(attr(n, "aria-label").isNotNull(), "region"))
        .otherwise(F.try_element_at(table, tag))
    )
    return F.coalesce(given, by_tag)


def labels_of(nodes: Column) -> Column:
    """What ``label_in`` needs of a page: the text of the first label for each id, and for every position how far the labels up to it reach and the newest."""
    found = F.filter(nodes, lambda n: n["tag"] == "label")
    ids = F.array_distinct(F.transform(F.filter(found, lambda x: attr(x, "for").isNotNull()), lambda x: attr(x, "for")))
    pointed = F.transform(F.filter(found, lambda x: attr(x, "for").isNotNull()), lambda x: F.struct(attr(x, "for").alias("id"), x["ord"].alias("ord")))
    first = let(F.array_sort(pointed), lambda p: F.map_from_entries(F.transform(
        F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1)["id"] != x["id"])), lambda x: F.struct(x["id"], text_of(nodes, F.get(nodes, x["ord"]))))))
    reach = running_max(F.transform(nodes, lambda n: F.when(n["tag"] == "label", n["last"]).otherwise(-1)))
    newest = running_max(F.transform(nodes, lambda n: F.when(n["tag"] == "label", n["ord"]).otherwise(-1)))
    none = F.array().cast("array<int>")
    some = F.size(found) > 0
    return F.struct(F.when(F.size(ids) > 0, first).alias("by_id"), F.when(some, reach).otherwise(none).alias("reach"),
                    F.when(some, newest).otherwise(none).alias("newest"))


def label_in(nodes: Column, labels: Column, n: Column) -> Column:
    """Text of the first label that points at a control's id, else of the innermost label wrapped around it, or null."""
    def wrapping(at: Column) -> Column:
        inner = F.get(nodes, at)
        return F.when(inner["last"] >= n["ord"], at).otherwise(  # labels inside labels: look back for the one that reaches here
            F.array_max(F.transform(F.filter(F.slice(nodes, 1, n["ord"]), lambda x: (x["tag"] == "label") & (x["last"] >= n["ord"])), lambda x: x["ord"])))

    wrapped = F.when(F.get(labels["reach"], n["ord"]) >= n["ord"], let(F.get(labels["newest"], n["ord"]), wrapping))
    by_id = F.when(attr(n, "id").isNotNull(), F.try_element_at(labels["by_id"], attr(n, "id")))
    return F.when(n["tag"].isin(*LABELLED_TAGS), F.coalesce(by_id, let(wrapped, lambda w: F.when(w.isNotNull(), text_of(nodes, F.get(nodes, w))))))


def name_from(n: Column, role: Column, label: Column, content: Column) -> Column:
    """Accessible name (our definition): aria-label, label, alt, value of buttons, text, title, placeholder."""

    def filled(c: Column) -> Column:
        return F.nullif(squash(F.coalesce(c, F.lit(""))), F.lit(""))

    button_value = F.when((n["tag"] == "input") & (role == "button"), F.coalesce(
        attr(n, "value"), F.when(attr(n, "type") == "submit", "Submit").when(attr(n, "type") == "reset", "Reset")))
    own_text = F.when(role.isin(*NAMED_BY_CONTENT) & (n["tag"] != "input"), content)
    return F.coalesce(
        filled(attr(n, "aria-label")), filled(label), filled(attr(n, "alt")), filled(button_value),
        filled(own_text), filled(attr(n, "title")), filled(attr(n, "placeholder")),
    )


def name_of(nodes: Column, labels: Column, n: Column, role: Column) -> Column:
    return name_from(n, role, label_in(nodes, labels, n), text_of(nodes, n))


def may_be_named_by_content(n: Column) -> Column:
    """Cheap test for elements whose text can become their name."""
    return n["tag"].isin("a", "button", "option", "th", "h1", "h2", "h3", "h4", "h5", "h6") | attr(n, "role").isNotNull()


def _says(text: Column, target: str, exact: bool) -> Column:
    clean = " ".join(target.split())
    hit = (text == clean) if exact else F.lower(text).contains(clean.lower())
    return F.coalesce(hit, F.lit(False))


def matches(nodes: Column, target: str, kind: str = "text", role: str | None = None, exact: bool = False) -> Column:
    """Elements a locator finds, as an array of node structs in document order."""
    elements = F.filter(nodes, lambda n: n["kind"] == "element")
    if kind == "text":
        unseen = ("script", "style", "noscript", "template", "head", "title", "html")
        said = F.filter(elements, lambda n: ~n["tag"].isin(*unseen) & _says(
            F.when((n["tag"] == "input") & attr(n, "type").isin("button", "submit"), attr(n, "value"))
            .otherwise(text_of(nodes, n)), target, exact))
        # Only the innermost matching elements count: those that the next one does not lie in.
        return let(said, lambda s: F.filter(s, lambda n, i: F.coalesce(F.get(s, i + 1)["ord"] > n["last"], F.lit(True))))
    if kind == "role":
        want = role or "button"
        return let(labels_of(nodes), lambda labels: F.filter(elements, lambda n: F.coalesce(role_of(n) == want, F.lit(False)) & _says(
            name_of(nodes, labels, n, F.lit(want)), target, exact)))
    if kind == "label":
        return let(labels_of(nodes), lambda labels: F.filter(elements, lambda n: _says(label_in(nodes, labels, n), target, exact)
                                                             | _says(squash(attr(n, "aria-label")), target, exact)))
    if kind == "placeholder":
        return F.filter(elements, lambda n: _says(squash(attr(n, "placeholder")), target, exact))
    if kind == "testid":
        return F.filter(elements, lambda n: F.coalesce(attr(n, "data-testid") == target, F.lit(False)))
    return let(css_flags(target)(nodes), lambda hit: F.filter(nodes, lambda n, i: F.get(hit, i)))


def locate(
    dom: DataFrame, target: str, kind: str = "text", role: str | None = None, exact: bool = False
) -> DataFrame:
    """One row per match: page_id, nth (1-based), ord, tag, text."""
    nodes = F.col("nodes")
    found = F.transform(matches(nodes, target, kind, role, exact), lambda n: F.struct(
        n["ord"].alias("ord"), n["tag"].alias("tag"), text_of(nodes, n).alias("text")))
    return dom.select("page_id", F.posexplode(found).alias("pos", "m")).select(
        "page_id", (F.col("pos") + 1).alias("nth"), "m.ord", "m.tag", "m.text")


def title_col_text(nodes: Column) -> Column:
    """Squeezed text of the title element, or null."""
    title = F.get(F.filter(nodes, lambda n: n["tag"] == "title"), F.lit(0))
    return let(title, lambda t: F.nullif(text_of(nodes, t), F.lit("")))
