"""Document text from parsed parts: pages, cells, shapes, messages, conversation turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_blank
from ..functions.regexes import SPACE
from ..operators.detect import detect, explode_findings
from ..operators.patterns import PatternSpec

#: Characters of a segment of a long document.
SEGMENT_CHARS = 4 * 1024 * 1024
#: Characters behind a segment that it also holds; longer findings across a border may be cut.
OVERLAP_CHARS = 1024
#: Characters of short segments that are scanned together, so that what they share is read once.
RUN_CHARS = 32 * 1024


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def _ordered_text(pieces: DataFrame, keys: list[str], order: list[str], separator: str) -> DataFrame:
    """Pieces (``order`` columns, ``piece``) joined per key in order; null pieces are skipped."""
    packed = F.sort_array(F.collect_list(F.struct(*order, "piece")))
    return pieces.filter(F.col("piece").isNotNull()).groupBy(*keys).agg(
        F.array_join(F.transform(packed, lambda p: p["piece"]), separator).alias("text")
    )


def _assemble(
    pieces: DataFrame, keys: list[str], order: list[str], max_chars: int | None, separator: str = "\n"
) -> DataFrame:
    """Join pieces into (keys, text, error).

    No document is left out: by default there is no limit, and a document becomes one value, which must fit one task. Documents
    too long for that are read as segments (``segments``). A caller who wants long documents reported as errors gives
    ``max_chars``; their lengths are summed first, and their pieces never reach a group.
    """
    if max_chars is None:
        return _ordered_text(pieces, keys, order, separator).withColumn("error", F.lit(None).cast("string"))
    over = (
        pieces.groupBy(*keys).agg(F.sum(F.length("piece") + len(separator)).alias("chars"))
        .filter(F.col("chars") > max_chars)
    )
    fine = _ordered_text(pieces.join(over.select(*keys), keys, "left_anti"), keys, order, separator)
    return fine.withColumn("error", F.lit(None).cast("string")).unionByName(
        over.select(
            *keys,
            F.lit(None).cast("string").alias("text"),
            F.format_string("Document too large (%d characters)", F.col("chars")).alias("error"),
        )
    )


def segments(
    pieces: DataFrame, keys: list[str], order: list[str], separator: str = "\n", chars: int = SEGMENT_CHARS, overlap: int = OVERLAP_CHARS
) -> DataFrame:
    """(keys, segment, base_offset, text, own_chars) of documents of any length.

    A running length, streamed in order, numbers the pieces; a segment holds the pieces that begin in its stretch of
    ``chars`` characters, and of those behind it all that begin within ``overlap`` characters of its end, so that a finding across the
    border is seen whole however many pieces it spans (up to that length). ``base_offset`` is where the segment begins in the whole
    document, and the next one begins ``own_chars`` characters behind that. The running length needs a document's pieces in one sorted stream, which spills; only a segment's pieces are held together.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.filter(F.col("piece").isNotNull()).withColumn(
        "_at", F.coalesce(F.sum(F.length("piece") + len(separator)).over(before), F.lit(0)).cast("long")
    )
    placed = placed.withColumn("_own", F.floor(F.col("_at") / chars).cast("long"))
    # the segment that the piece ``overlap`` characters before is in, and all after it, end near enough
    reach = Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, -overlap)
    nearest = Window.partitionBy(*keys).orderBy("_at").rowsBetween(-1, -1)
    first = F.least(F.coalesce(F.max("_own").over(reach), F.lit(0)), F.coalesce(F.max("_own").over(nearest), F.lit(0)))
    parts = placed.withColumn("_from", first).select("*", F.explode(F.sequence("_from", "_own")).alias("segment"))
    packed = F.sort_array(F.collect_list(F.struct("_at", *order, "piece")))
    held = parts.groupBy(*keys, "segment").agg(
        F.min("_at").alias("base_offset"), F.array_join(F.transform(packed, lambda p: p["piece"]), separator).alias("text"),
        F.sum(F.when(F.col("_own") == F.col("segment"), F.length("piece") + len(separator))).cast("long").alias("own_chars"),
    )
    return held.filter("own_chars IS NOT NULL")


def runs_of_segments(parts: DataFrame, keys: list[str], chars: int = RUN_CHARS) -> DataFrame:
    """(keys, base_offset, text): neighbouring segments that begin in the same stretch of ``chars`` characters, as the one text they are cut from.

    A segment shares up to ``overlap`` characters with those behind it; of all but a run's last one only the own ones are taken.
    """
    run = F.floor(F.col("base_offset") / chars).alias("_run")
    held = F.sort_array(F.collect_list(F.struct("base_offset", "own_chars", "text")))
    texts = F.transform("_held", lambda s, i: F.when(i == F.size("_held") - 1, s["text"]).otherwise(F.substring(s["text"], 1, s["own_chars"].cast("int"))))
    rows = parts.groupBy(*keys, run).agg(F.min("base_offset").alias("base_offset"), held.alias("_held"))
    return rows.select(*keys, "base_offset", F.array_join(texts, "").alias("text"))


def findings_of_segments(parts: DataFrame, keys: list[str], patterns: list[PatternSpec] | None = None) -> DataFrame:
    """Findings of segmented documents with offsets in the whole document; a finding in two segments counts once.

    Short segments are scanned several at a time: each alone would be read with all it shares with those behind it.
    """
    parts = runs_of_segments(parts, keys)
    rows = explode_findings(parts.select(*keys, "base_offset", detect(F.col("text"), patterns).alias("matches")))
    moved = rows.withColumn("start", F.col("start") + F.col("base_offset")).withColumn("end", F.col("end") + F.col("base_offset"))
    return moved.drop("base_offset").dropDuplicates([*keys, "start", "end", "entity_type"])


def assemble_pages(pages: DataFrame, key: str = "doc", max_chars: int | None = None) -> DataFrame:
    """(doc, page, text) -> document text with a header per page; blank pages keep their number only."""
    pieces = pages.filter(~is_blank(F.col("text"))).select(
        key, "page", F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), F.col("text")).alias("piece")
    )
    return _assemble(pieces, [key], ["page"], max_chars)


def assemble_sheets(cells: DataFrame, key: str = "doc", max_chars: int | None = None) -> DataFrame:
    """(doc, sheet_no, sheet, row, col, value) -> text: a header per sheet, cells joined by bars.

    Null cells are left out and empty rows dropped; a sheet without cells keeps its header.
    Rows are built first (small groups), so the document group holds one piece per row.
    """
    lines = (
        cells.filter(F.col("value").isNotNull())
        .groupBy(key, "sheet_no", "row")
        .agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("cells"))
        .select(
            key, "sheet_no", "row",
            F.array_join(F.transform("cells", lambda c: c["value"]), " | ").alias("piece"),
        )
    )
    headers = cells.groupBy(key, "sheet_no").agg(F.min("sheet").alias("sheet")).select(
        key, "sheet_no", F.lit(-1).cast(cells.schema["row"].dataType).alias("row"),
        F.concat(F.lit("[Sheet: "), F.col("sheet"), F.lit("]")).alias("piece"),
    )
    return _assemble(lines.unionByName(headers), [key], ["sheet_no", "row"], max_chars)


def assemble_slides(shapes: DataFrame, key: str = "doc", max_chars: int | None = None) -> DataFrame:
    """(doc, slide, seq, kind, text) -> text; ``kind`` is text, table or notes.

    Paragraphs and table rows are trimmed, blank ones dropped; notes follow the shapes of a slide.
    """
    notes = F.col("kind") == "notes"
    body = shapes.filter(~is_blank(F.col("text"))).select(
        key, "slide",
        F.when(notes, 2).otherwise(1).alias("part"),
        F.col("seq").cast("long").alias("seq"),
        F.when(notes, F.concat(F.lit("[Notes]\n"), F.col("text"))).otherwise(_strip(F.col("text"))).alias("piece"),
    )
    headers = shapes.select(key, "slide").distinct().select(
        key, "slide", F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"),
        F.concat(F.lit("[Slide "), F.col("slide").cast("string"), F.lit("]")).alias("piece"),
    )
    return _assemble(body.unionByName(headers), [key], ["slide", "part", "seq"], max_chars)


def message_text(
    sender: Column, to: Column, cc: Column, subject: Column, date: Column, body: Column, attachments: Column
) -> Column:
    """Message headers that are present, a blank line, the body, and the attachment names (no shuffle)."""

    def line(name: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))

    names = F.filter(attachments, lambda a: a.isNotNull() & (a != ""))
    tail = F.when(
        F.size(F.coalesce(names, F.array())) > 0,
        F.concat(F.lit("\n[Attachments]\n"), F.array_join(F.transform(names, lambda a: F.concat(F.lit("- "), a)), "\n")),
    )
    return F.concat_ws(
        "\n",
        line("From", sender), line("To", to), line("CC", cc), line("Subject", subject), line("Date", date),
        F.lit(""),
        F.when(F.coalesce(body, F.lit("")) != "", body),
        tail,
    )


def assemble_turns(
    turns: DataFrame, key: str = "conv_id", max_chars: int | None = None
) -> DataFrame:
    """(key, turn, role, text) -> one text per conversation, ``role: text`` lines in turn order."""
    pieces = turns.select(key, "turn", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("piece"))
    return _assemble(pieces, [key], ["turn"], max_chars)


def assemble_document(parts: DataFrame, key: str = "doc", max_chars: int | None = None) -> DataFrame:
    """(doc, kind, seq, row, col, text) of word-processor files -> text.

    Paragraphs that aren't blank come first, then table rows (their trimmed, non-blank cells joined by bars), then headers, then
    footers; ``kind`` is paragraph, cell, header or footer, ``seq`` numbers paragraphs, tables and sections, and ``row`` and
    ``col`` place a cell in its table.
    """
    seen = parts.filter(~is_blank(F.col("text")))
    place = F.expr("CASE kind WHEN 'paragraph' THEN 0 WHEN 'cell' THEN 1 WHEN 'header' THEN 2 ELSE 3 END")
    flat = seen.filter("kind <> 'cell'").select(
        key, place.alias("part"), F.col("seq").cast("long").alias("seq"), F.lit(0).cast("long").alias("row"), F.col("text").alias("piece")
    )
    cells = seen.filter("kind = 'cell'").groupBy(key, F.col("seq").cast("long").alias("seq"), F.col("row").cast("long").alias("row")).agg(
        F.sort_array(F.collect_list(F.struct("col", _strip(F.col("text")).alias("text")))).alias("cells")
    )
    rows = cells.select(key, F.lit(1).alias("part"), "seq", "row", F.array_join(F.transform("cells", lambda c: c["text"]), " | ").alias("piece"))
    return _assemble(flat.unionByName(rows), [key], ["part", "seq", "row"], max_chars)
