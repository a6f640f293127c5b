"""Pages to topic metadata.

The source is a table of already fetched pages ``(page_id, url, html[,
status])``. Link extraction has two forms:

* ``page_links`` - the stdlib HTML parser with an open-tag stack, over Arrow
  batches of pages in the executors: exact descendant-path semantics for
  arbitrary markup (nested blocks, anchors off the path, any quoting).
* ``page_links_regex`` - native regexes (JVM): anchors inside the blocks of the
  first path element, in document order. Only right for flat pages whose
  anchors in that block all sit on the path.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import split_words, ustrip
from quarry.operators.ids import dense_index

# Default crawl parameters and output formats.
DEFAULT_PATH = ["div.mw-parser-output", "ul", "li", "a"]
DEFAULT_KEYWORD = "algorithm"
MAX_TOPIC_LEN = 40  # kept topics are shorter than this (a parameter of crawl_topics)
CRAWLED_TAG = "Algorithm"
OBJECTIVE_FMT = "Understand the core properties and runtime behavior of %s."
BASELINE_FILE_FMT = "metadata_baseline_%04d"
CRAWLED_FILE_FMT = "metadata_crawled_%04d"

# The baseline topic table (topic, difficulty, tags, concept, learning objective).
BASELINE_TOPICS = [
    ("Sliding Window", "Medium", ["Array", "Two Pointer"], "Variable Window Size",
     "Optimize subsegment tracking dynamically"),
    ("Sliding Window", "Easy", ["Array", "String"], "Fixed Window Size",
     "Maintain cumulative state in linear time"),
    ("Two Pointers", "Easy", ["Array", "Two Pointer"], "Opposite ends convergence",
     "Find pairs satisfying sorting bounds"),
    ("Two Pointers", "Medium", ["Array", "Sorting"], "Fast and slow pointer",
     "Detect cycle patterns in list structures"),
    ("Binary Search", "Medium", ["Array", "Binary Search"], "Search space reduction",
     "Perform binary search on answer range"),
    ("Binary Search", "Hard", ["Array", "Optimization"], "Maximize minimum distance",
     "Find optimal threshold in structured intervals"),
    ("Prefix Sum", "Easy", ["Array", "Prefix Sum"], "Range query indexing",
     "Perform dynamic constant-time sum queries"),
    ("Breadth First Search", "Medium", ["Graph", "BFS"], "Shortest path in unweighted graph",
     "Explore layer-by-layer traversal"),
    ("Depth First Search", "Medium", ["Graph", "DFS", "Tree"], "Backtracking search",
     "Explore recursive path traversal"),
    ("Dynamic Programming", "Medium", ["Dynamic Programming", "Memoization"], "1D State Transition",
     "Optimize recursive subproblems"),
    ("Dynamic Programming", "Hard", ["Dynamic Programming", "Grid"], "2D Grid Path optimization",
     "Minimize path cost on state grids"),
    ("Heaps & Priority Queues", "Medium", ["Heap", "Priority Queue"], "K-way Merge",
     "Maintain ordered elements in dynamic collections"),
    ("Monotonic Stack", "Medium", ["Stack", "Monotonic Stack"], "Next Greater Element",
     "Track previous or next optimal indexes in linear time"),
]

META_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("difficulty", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("concept", T.StringType()),
    T.StructField("learning_objective", T.StringType()),
])

LINKS_SCHEMA = "page_id long, pos int, href string, text string"


def baseline_metadata(spark: SparkSession) -> DataFrame:
    """The static baseline topics with their file names."""
    rows = [(BASELINE_FILE_FMT % (i + 1), "baseline", i) + t for i, t in enumerate(BASELINE_TOPICS)]
    return spark.createDataFrame(
        rows, "file_name string, origin string, idx long, topic string, difficulty string, "
              "tags array<string>, concept string, learning_objective string")


def _tag_name(step: str) -> tuple[str, str | None]:
    if "." in step:
        tag, cls = step.split(".", 1)
        return tag, cls
    return step, None


def _unescape_basic(c):
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def page_links_regex(pages: DataFrame, path=None, ok_status_only: bool = True) -> DataFrame:
    """P1 for flat pages: ``(page_id, pos, href, text)`` in document order."""
    path = path or DEFAULT_PATH
    if ok_status_only and "status" in pages.columns:
        pages = pages.where(F.col("status") == 200)
    outer, cls = _tag_name(path[0])
    leaf, _ = _tag_name(path[-1])
    if cls:
        open_re = rf'<{outer}\b[^>]*class="[^"]*\b{cls}\b[^"]*"[^>]*>'
    else:
        open_re = rf"<{outer}\b[^>]*>"
    blocks = F.regexp_extract_all(F.col("html"), F.lit(rf"(?is){open_re}(.*?)</{outer}>"), 1)
    inner = F.array_join(blocks, "\n")
    anchors = F.regexp_extract_all(inner, F.lit(rf"(?is)<{leaf}\b([^>]*)>(.*?)</{leaf}>"), 0)
    x = pages.select("page_id", F.posexplode(anchors).alias("pos", "a"))
    attrs = F.regexp_extract("a", rf"(?is)^<{leaf}\b([^>]*)>", 1)
    body = F.regexp_extract("a", rf"(?is)^<{leaf}\b[^>]*>(.*)</{leaf}>$", 1)
    return x.select(
        "page_id", F.col("pos").cast("int").alias("pos"),
        _unescape_basic(F.regexp_extract(attrs, r'(?i)href\s*=\s*"([^"]*)"', 1)).alias("href"),
        ustrip(_unescape_basic(F.regexp_replace(body, r"<[^>]*>", ""))).alias("text"))


class _PathCollector(HTMLParser):
    """Collect elements matching a descendant tag path (tag or tag.class)."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
            "source", "track", "wbr"}

    def __init__(self, path):
        super().__init__(convert_charrefs=True)
        self.path = [_tag_name(s) for s in path]
        self.stack: list[tuple[str, set]] = []
        self.out: list[list] = []      # [href, [text parts]]
        self.open: list[tuple[int, int]] = []  # (depth, place in out) of matches still open
        self.skip = 0

    def _matches(self) -> bool:
        # greedy subsequence match of the path against the open-tag stack,
        # with the last step on the top element.
        want = self.path
        tag, cls = want[-1]
        top_tag, top_cls = self.stack[-1]
        if top_tag != tag or (cls and cls not in top_cls):
            return False
        i = 0
        for t, c in self.stack[:-1]:
            if i < len(want) - 1 and t == want[i][0] and (not want[i][1] or want[i][1] in c):
                i += 1
        return i == len(want) - 1

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        if tag in self.VOID:
            return
        self.stack.append((tag, set((a.get("class") or "").split())))
        if self._matches():
            self.out.append([a.get("href") or "", []])
            self.open.append((len(self.stack), len(self.out) - 1))

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.skip:
            self.skip -= 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                while self.open and self.open[-1][0] > i:
                    self.open.pop()
                del self.stack[i:]
                break

    def handle_data(self, data):
        if not self.skip:
            for _, place in self.open:  # a match's text holds that of the matches inside it
                self.out[place][1].append(data)


def _extract_links(path):
    def run(batches):
        for batch in batches:
            rows = []
            for pid, doc in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                p = _PathCollector(path)
                p.feed(doc or "")  # the parser takes any markup; it has unescaped attributes already
                p.close()
                rows += [(pid, pos, href, "".join(parts).strip()) for pos, (href, parts) in enumerate(p.out)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                             ["page_id", "pos", "href", "text"])
    return run


def page_links(pages: DataFrame, path=None, ok_status_only: bool = True) -> DataFrame:
    """``(page_id, pos, href, text)`` of the elements on a descendant path,
    in document order."""
    path = path or DEFAULT_PATH
    if ok_status_only and "status" in pages.columns:
        pages = pages.where(F.col("status") == 200)
    return (pages.select(F.col("page_id").cast("long").alias("page_id"), "html")
            .mapInArrow(_extract_links(path), LINKS_SCHEMA))


def crawl_topics(links: DataFrame, head: int | None = None, keyword: str = DEFAULT_KEYWORD,
                 max_len: int = MAX_TOPIC_LEN) -> DataFrame:
    """P2 (+W5): non-empty texts shorter than ``max_len`` with the keyword.

    ``head`` keeps the first links of a page only - politeness to a live site,
    which a table of fetched pages does not need; by default all count."""
    t = F.col("text")
    if head is not None:
        links = links.where(F.col("pos") < head)
    return links.where((F.length(t) >= 1) & (F.length(t) < max_len) & F.lower(t).contains(keyword.lower()))


def crawled_metadata(topics: DataFrame) -> DataFrame:
    """Number kept topics globally in (page_id, pos) order; alternate
    Medium/Hard on that number; tags = [first word, Algorithm]."""
    numbered = dense_index(topics, ["page_id", "pos"], "idx")
    words = split_words(F.col("text"))
    return numbered.select(
        F.format_string(CRAWLED_FILE_FMT, F.col("idx") + 1).alias("file_name"),
        F.lit("crawled").alias("origin"), "idx",
        F.col("text").alias("topic"),
        F.when(F.col("idx") % 2 == 0, F.lit("Medium")).otherwise(F.lit("Hard")).alias("difficulty"),
        F.when(F.size(words) > 0, F.array(words[0], F.lit(CRAWLED_TAG)))
        .otherwise(F.array(F.lit(CRAWLED_TAG))).alias("tags"),
        F.col("text").alias("concept"),
        F.format_string(OBJECTIVE_FMT, F.col("text")).alias("learning_objective"))


def metadata_collection(spark: SparkSession, pages: DataFrame, path=None, head: int | None = None,
                        keyword: str = DEFAULT_KEYWORD) -> DataFrame:
    """Baseline rows followed by crawled rows, keyed by file name."""
    crawled = crawled_metadata(crawl_topics(page_links(pages, path), head, keyword))
    return baseline_metadata(spark).unionByName(crawled)


def saved_count(collection: DataFrame) -> DataFrame:
    """Number of metadata records written."""
    return collection.agg(F.count(F.lit(1)).alias("saved_count"))
