"""Building and maintaining the word-to-document index: joins, upserts and set operations."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions import tokens as K
from siftwell.functions import urls as U
from siftwell.functions.arrays import no_null_lists
from siftwell.sources.shared import written

REMOVED, CREATED, MODIFIED, UNMODIFIED, NOT_INDEXED = range(5)
LOCAL_STATES = [U.PUBLISHED, U.CACHED, U.PRIVATE]


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the given order."""
    return df.withColumn("place in key", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place in key") == 1).drop("place in key")


def select_where(df: DataFrame, **equal: object) -> DataFrame:
    """Equality filters joined by AND; they reach the scan."""
    for name, value in equal.items():
        df = df.where(F.col(name) == value)
    return df


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key (null is a key as well): the greatest by its other columns in their order, as in ``max`` of a struct."""
    others = [c for c in df.columns if c not in keys]
    return latest_per_key(df, keys, *(F.desc_nulls_last(F.col(f"`{c}`")) for c in others or keys))


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys of which null equals null; the key columns are those of either side."""
    other = right.withColumnsRenamed({k: f"right {k}" for k in keys})
    condition = functools.reduce(lambda x, y: x & y, (left[k].eqNullSafe(other[f"right {k}"]) for k in keys))
    joined = left.join(other, condition, how)
    return joined if how in ("left_anti", "left_semi") else joined.withColumns({k: F.coalesce(k, f"`right {k}`") for k in keys}).drop(*(f"right {k}" for k in keys))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changed keys take the new row, others keep theirs; of several changes of a key the greatest row counts."""
    new = one_per_key(changes.select(*current.columns), keys)
    return matched(current, new.select(*keys), keys, "left_anti").select(*current.columns).unionByName(new)


def path_scope(files: DataFrame, private: list[str], public: list[str], skipped: list[str]) -> DataFrame:
    """Files below the indexed folders and not below a skipped one; a public folder overrides a private one."""

    def below(folders: list[str]) -> Column:
        found = F.lit(False)
        for folder in folders:
            found = found | F.col("file_name").startswith(folder.rstrip("/") + "/")
        return found

    scope = F.when(below(public), "public").when(below(private), "private")
    return files.where(~below(skipped)).withColumn("scope", scope).where(F.col("scope").isNotNull())


def filter_known_types(files: DataFrame) -> DataFrame:
    return files.withColumn("mime_type", U.mime_from_path(F.col("file_name"))).where(F.col("mime_type").isNotNull())


def last_indexed(crawl: DataFrame, files: DataFrame) -> DataFrame:
    """Last stored time and state of each crawled path; (0, unknown) for a new one."""
    known = files.select("file_name", F.col("file_time").alias("known_time"), F.col("state").alias("known_state"))
    return crawl.join(known, "file_name", "left").select(*crawl.columns, F.coalesce("known_time", F.lit(0)).alias("known_time"), F.coalesce("known_state", F.lit(U.UNKNOWN)).alias("known_state"))


def detect_changes(crawl: DataFrame, files: DataFrame) -> DataFrame:
    """``change`` of each crawled path: untouched if its state is the stored one and the stored time is not older."""
    found = last_indexed(crawl, files)
    untouched = (F.col("known_state") == F.col("state")) & (F.col("known_time") >= F.col("file_time"))
    change = F.when(untouched, "untouched").when(F.col("known_state") == U.UNKNOWN, "new").otherwise("modified")
    return found.withColumn("change", change).drop("known_time", "known_state")


def vanished_files(files: DataFrame, crawl: DataFrame) -> DataFrame:
    return files.join(crawl.select("file_name").distinct(), "file_name", "left_anti")


def existing_files(private: DataFrame, public: DataFrame) -> DataFrame:
    return private.select("file_name").union(public.select("file_name")).distinct()


def dedupe_content(extracted: DataFrame) -> DataFrame:
    """One document for each content, in the state of its last file (the greatest id of equal times).

    Only metadata is grouped; the chosen path's text is joined back.
    """
    with_id = extracted.withColumn("document_id", T.content_id(F.col("text")))
    chosen = with_id.groupBy("document_id").agg(F.min("file_id").alias("db_document_id"), F.max("file_time").alias("publication_time"), F.max_by("state", F.struct("file_time", "file_id")).alias("state"))
    body = extracted.select(F.col("file_id").alias("db_document_id"), "mime_type", "title", "text", F.octet_length("text").cast("long").alias("size"), U.encode_url(F.col("file_name")).alias("url"))
    out = chosen.join(body, "db_document_id")
    return out.select("db_document_id", "document_id", "mime_type", "title", "size", "text", "publication_time", "state", F.lit(0.0).alias("download_count"), "url", F.lit(0.0).alias("matching"))


def link_files(extracted: DataFrame, documents: DataFrame) -> DataFrame:
    """Files with the document that holds their content."""
    with_id = extracted.select("file_name", "file_time", T.content_id(F.col("text")).alias("document_id"), "state", "file_state")
    return with_id.join(documents.select("document_id", "db_document_id"), "document_id").select("file_name", "file_time", "db_document_id", "state", "file_state")


def assign_document_ids(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` with ids above the greatest known one, in order of ``key``, without a gap.

    Rows are dealt into ranges of the key and written once, each with its place in its range; what
    was written is counted, and each range starts where the one before ends. No task sees all rows,
    and no range is drawn twice. Equal keys get neighbouring ids in any order, null keys the first.
    """
    mark = F.monotonically_increasing_id()  # the number of the range above, the place in it in the lower 33 bits
    dealt = written(new.repartitionByRange(key).sortWithinPartitions(key).withColumn("range mark", mark), "ranged")
    part, place = F.shiftright("range mark", 33), F.col("range mark").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("range no")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range no", (F.sum("n").over(Window.orderBy("range no")) - F.col("n")).alias("before"))  # one row a range
    top = known.agg(F.coalesce(F.max("db_document_id"), F.lit(-1)).alias("top"))  # one row
    numbered = dealt.withColumn("range no", part).join(F.broadcast(before), "range no").crossJoin(F.broadcast(top))
    return numbered.select(*(F.col(f"`{c}`") for c in new.columns), (F.col("top") + F.col("before") + place + 1).cast("long").alias("db_document_id"))


def relink_changed_file(extracted: DataFrame, files: DataFrame, documents: DataFrame) -> DataFrame:
    """What to do with each extracted path: relink (other content), update_state, keep or new_file."""
    ids = documents.select("db_document_id", F.col("document_id").alias("known_id"))
    known = files.select("file_name", "db_document_id", F.col("state").alias("known_state")).join(ids, "db_document_id")
    found = extracted.select("file_name", "state", T.content_id(F.col("text")).alias("document_id")).join(known.select("file_name", "known_id", "known_state"), "file_name", "left")
    action = F.when(F.col("known_id").isNull(), "new_file").when(F.col("known_id") != F.col("document_id"), "relink").when(F.col("known_state") != F.col("state"), "update_state").otherwise("keep")
    return found.select("file_name", "document_id", "state", action.alias("action"))


def token_positions(documents: DataFrame, text: Column) -> DataFrame:
    """db_document_id, n, word, position: every token with its offset in the normalized text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data, at in K.blocks(batch.column(1)):
                found = K.tokens(data, at)
                own = batch.column(0).take(pa.array(found.text + start))
                yield pa.RecordBatch.from_arrays([own, pa.array(found.nth.astype(np.int32)), found.words, pa.array(found.position.astype(np.int32))], names=["db_document_id", "n", "word", "position"])

    normal = documents.select(F.col("db_document_id").cast("long").alias("db_document_id"), T.normalize_text(text).alias("normal"))
    return normal.mapInArrow(run, "db_document_id long, n int, word string, position int")


def posting_lists(documents: DataFrame) -> DataFrame:
    """db_document_id, words, positions: a document's words with their first positions, title and text together; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data, at in K.blocks(batch.column(1)):
                found = K.tokens(data, at)
                first = K.first_of_each(found)
                bounds = pa.array(np.searchsorted(found.text[first], np.arange(len(at))).astype(np.int32))
                words = pa.ListArray.from_arrays(bounds, found.words.take(pa.array(first)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(at) - 1), words, pa.ListArray.from_arrays(bounds, pa.array(found.position[first].astype(np.int32)))], names=["db_document_id", "words", "positions"])

    normal = documents.select(F.col("db_document_id").cast("long").alias("db_document_id"), T.normalize_text(T.index_text(F.col("title"), F.col("text"))).alias("normal"))
    return normal.mapInArrow(run, "db_document_id long, words array<string>, positions array<int>")


def postings_of(lists: DataFrame) -> DataFrame:
    """(document, word) rows of ``posting_lists``. What is chosen by document alone is better chosen among the lists."""
    rows = lists.select("db_document_id", F.explode(F.arrays_zip("words", "positions")).alias("p"))
    zero = F.lit(0.0)
    return rows.select("db_document_id", F.col("p.words").alias("word"), F.col("p.positions").alias("position"), zero.alias("download_count"), zero.alias("relevance"), zero.alias("popularity"))


def build_postings(documents: DataFrame) -> DataFrame:
    """(document, word) with its first position and zero scores; title and text are indexed together.

    First positions are found where the document is read, so nothing is shuffled.
    """
    return postings_of(posting_lists(documents))


SCORES = ["download_count", "relevance", "popularity"]


def by_pair(rows: DataFrame, *aggregates: Column) -> DataFrame:
    """``aggregates`` of each (document, word); rows are dealt out once, by document, and hashed where they come, without a sort."""
    return rows.repartition("db_document_id").groupBy("db_document_id", "word").agg(*aggregates)


def merge_postings(postings: DataFrame, fresh: DataFrame) -> DataFrame:
    """Known pairs keep their scores and take the new position, new ones come in, gone ones stay. A pair that comes in twice takes its last position.

    (document, word) is the key of ``postings``. Both tables are one, dealt out once.
    """
    known = postings.select("db_document_id", "word", "position", *SCORES, F.lit(None).cast("int").alias("new_position"))
    new = fresh.select("db_document_id", "word", F.col("position").alias("new_position"))
    both = by_pair(known.unionByName(new, allowMissingColumns=True), *(F.max(c).alias(c) for c in ("position", "new_position", *SCORES)))
    return both.select("db_document_id", "word", F.coalesce("new_position", "position").alias("position"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in SCORES))


def extend_vocabulary(words: DataFrame, postings: DataFrame) -> DataFrame:
    new = postings.select("word").distinct().join(words, "word", "left_anti")
    return words.select("word", "claim_count", "download_count").union(new.select("word", F.lit(0.0), F.lit(0.0)))


def remove_unreferenced_documents(documents: DataFrame, files: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with a file, postings with such a document, removed row counts)."""
    kept = documents.join(files.select("db_document_id").distinct(), "db_document_id", "left_semi")
    scores = drop_orphan_scores(postings, kept)
    gone = documents.join(files.select("db_document_id").distinct(), "db_document_id", "left_anti")
    lost = postings.join(kept.select("db_document_id"), "db_document_id", "left_anti")
    return kept, scores, gone.agg(F.count(F.lit(1)).alias("documents")).crossJoin(lost.agg(F.count(F.lit(1)).alias("postings")))


def remove_document(table: DataFrame, ids: DataFrame) -> DataFrame:
    """``table`` (documents, providers, files or postings) without the given document ids."""
    return table.join(ids.select("db_document_id").distinct(), "db_document_id", "left_anti")


def remove_document_everywhere(ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """The cascade: documents, files, postings and providers without the given documents."""
    return {name: remove_document(table, ids) for name, table in tables.items()}


def drop_orphan_scores(postings: DataFrame, documents: DataFrame) -> DataFrame:
    """``postings`` (rows or ``posting_lists``) of the documents that are there."""
    return postings.join(documents.select("db_document_id"), "db_document_id", "left_semi")


def mark_and_sweep_files(files: DataFrame, crawl: DataFrame, state: int) -> DataFrame:
    """Files of a state that were not crawled again are deleted; the others are created or unmodified."""
    seen = crawl.select("file_name", F.lit(True).alias("seen")).distinct()
    marked = files.join(seen, "file_name", "left")
    kept = marked.where((F.col("state") != state) | F.coalesce("seen", F.lit(False)))
    file_state = F.when(F.col("state") == state, F.lit(UNMODIFIED)).otherwise(F.col("file_state"))
    return kept.select("file_name", "file_time", "db_document_id", "state", file_state.alias("file_state"))


def list_files(files: DataFrame, limit: int, offset: int = 0, after: str | None = None, state: int | None = None, name: str | None = None) -> DataFrame:
    """Files by name, from the one after ``after`` on."""
    if after is not None:
        files = files.where(F.col("file_name") > after)
    if state is not None:
        files = files.where(F.col("state") == state)
    if name is not None:
        files = files.where(F.col("file_name").contains(name))
    return files.orderBy("file_name").offset(offset).limit(limit)


def merge_known_document(documents: DataFrame, incoming: DataFrame) -> DataFrame:
    """Peers' descriptions: new documents come in as KNOWN; local copies keep their fields but fill an empty url. Of several of one document the greatest counts."""
    new = one_per_key(incoming, ["document_id"]).select("document_id", *(F.col(c).alias(f"new_{c}") for c in ("mime_type", "title", "size", "publication_time", "url")))
    both = matched(documents, new, ["document_id"], "full")
    local = F.col("state").isin(LOCAL_STATES)
    fields = [F.when(local | F.col(f"new_{c}").isNull(), F.col(c)).otherwise(F.col(f"new_{c}")).alias(c) for c in ("mime_type", "title", "size", "publication_time")]
    url = F.when(local, F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("new_url"))).otherwise(F.coalesce("new_url", "url"))
    return both.select("document_id", *fields, F.coalesce("state", F.lit(U.KNOWN)).alias("state"), url.alias("url"))


def merge_known_scores(postings: DataFrame, incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """Peers' word scores: ignored for local documents, else they overwrite; of several of one pair the greatest counts.

    (document, word) is the key of ``postings``. Local documents' scores go before anything is dealt out; what is left and the postings are one table then.
    """
    remote = documents.where(~F.col("state").isin(LOCAL_STATES)).select("db_document_id")
    news = ["new_relevance", "new_popularity"]
    named = incoming.select("db_document_id", "word", F.col("relevance").alias(news[0]), F.col("popularity").alias(news[1])).join(remote, "db_document_id", "left_semi")
    own = one_per_key(named.repartition("db_document_id"), ["db_document_id", "word"])
    both = by_pair(postings.select("db_document_id", "word", "position", *SCORES).unionByName(own, allowMissingColumns=True), *(F.max(c).alias(c) for c in ("position", *SCORES, *news)))
    return both.select("db_document_id", "word", F.coalesce("position", F.lit(-1)).alias("position"), F.coalesce("download_count", F.lit(0.0)).alias("download_count"), F.coalesce("new_relevance", "relevance").alias("relevance"), F.coalesce("new_popularity", "popularity").alias("popularity"))


def patch_sparse_text(excerpts: DataFrame, known: DataFrame) -> DataFrame:
    """db_document_id, text: excerpts (position, excerpt, or lists of them as positions, excerpts) laid at their offsets over the known text (null: none), later offsets over earlier ones, blanks where nothing is known.

    Bytes that are no UTF-8 count as U+FFFD. Of excerpts at one offset the greater text lies above. Null offsets and texts, and offsets below 0,
    are left out. A task holds one document at a time. A sweep over a document's excerpts in order of their offsets keeps those that are still
    open, the last on top; what each shows is cut once, so the work grows with the text and n log n.
    """

    def laid(text: str, places: list[tuple[int, str]]) -> str:
        out: list[str] = []
        at = 0  # up to here the text is made
        stack: list[tuple[int, str]] = []  # open excerpts, the later above

        def show(upto: int) -> None:
            nonlocal at
            while at < upto:
                while stack and stack[-1][0] + len(stack[-1][1]) <= at:
                    stack.pop()
                if stack:
                    begin, excerpt = stack[-1]
                    end = min(upto, begin + len(excerpt))
                    out.append(excerpt[at - begin : end - begin])
                else:
                    end = upto
                    out.append(text[at:end].ljust(end - at))
                at = end

        far = 0  # up to here excerpts are open
        for begin, excerpt in sorted(places):
            if begin < far:
                show(begin)
                stack.append((begin, excerpt))
                far = max(far, begin + len(excerpt))
                continue
            # nothing is open there, so this one is kept until the next comes
            show(far)
            stack.clear()
            if at < begin:
                out.append(text[at:begin].ljust(begin - at))
                at = begin
            stack.append((begin, excerpt))
            far = begin + len(excerpt)
        show(max([len(text), *(begin + len(excerpt) for begin, excerpt in places)]))
        return "".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, text, places, any_of = None, "", [], False
        for batch in batches:
            made: list[tuple[int | None, str]] = []
            ids, kind = (batch.column(c).to_pylist() for c in range(2))
            for i in range(batch.num_rows):
                if i == 0 and now is None or ids[i] != now[0]:
                    if any_of:
                        made.append((now[0], laid(text, places)))
                    now, text, places, any_of = (ids[i],), None, [], False
                if kind[i] == 0:
                    text = batch.column(2)[i].as_py() if text is None else text
                    continue
                text, any_of = text or "", True
                at, pieces = batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                places += [(p, x) for p, x in zip(at, pieces, strict=True) if p is not None and p >= 0 and x is not None]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string())], names=["db_document_id", "text"])
        if any_of:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([laid(text, places)], pa.string())], names=["db_document_id", "text"])

    document = F.col("db_document_id").cast("long").alias("db_document_id")
    lists = {"positions": "array<bigint>", "excerpts": "array<string>"}
    if "positions" not in excerpts.columns:
        excerpts = excerpts.select("db_document_id", F.array("position").alias("positions"), F.array("excerpt").alias("excerpts"))
    pieces = excerpts.select(document, F.lit(1).alias("kind"), F.col("positions").cast(lists["positions"]).alias("positions"), F.transform("excerpts", F.make_valid_utf8).alias("excerpts"))
    texts = known.select(document, F.lit(0).alias("kind"), F.make_valid_utf8("text").alias("text"))
    rows = texts.unionByName(pieces, allowMissingColumns=True).repartition("db_document_id").sortWithinPartitions("db_document_id", "kind")
    return no_null_lists(rows.select("db_document_id", "kind", "text", *lists)).mapInArrow(run, "db_document_id long, text string")


def merge_providers(providers: DataFrame, incoming: DataFrame) -> DataFrame:
    """The greatest providing time of each (document, node)."""
    return providers.unionByName(incoming).groupBy("db_document_id", "node_id").agg(F.max("last_providing_time").alias("last_providing_time"))


def calls_marked(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Index calls with ``accepted``: whether the node is registered. Each call is read once."""
    known = nodes.select("node_id").distinct().withColumn("accepted", F.lit(True))
    return calls.join(known, "node_id", "left").select(*calls.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"))


def provider_must_exist(calls: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) index calls by whether the node is registered."""
    marked = calls_marked(calls, nodes)
    return marked.where("accepted").drop("accepted"), marked.where("not accepted").drop("accepted")


def index_progress(changes: DataFrame) -> DataFrame:
    """Counts of new, untouched, private and public files of a crawl."""
    return changes.agg(F.count_if(F.col("change") == "new").alias("new"), F.count_if(F.col("change") == "modified").alias("modified"), F.count_if(F.col("change") == "untouched").alias("untouched"), F.count_if(F.col("state") == U.PRIVATE).alias("private"), F.count_if(F.col("state") == U.PUBLISHED).alias("public"))


def url_versions(documents: DataFrame) -> DataFrame:
    """All stored versions of each url in order of time, with a date and the first 80 characters."""
    version = F.row_number().over(Window.partitionBy("url").orderBy("publication_time", "db_document_id"))
    return documents.select("url", "db_document_id", version.alias("version"), U.publication_date(F.col("publication_time")).alias("published"), F.substring("text", 1, 80).alias("excerpt"))
