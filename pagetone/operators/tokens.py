"""Text of content streams and its tokens. Everything is local to the row that holds the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetone.functions import patterns as P
from pagetone.functions.color import let
from pagetone.functions.regions import cut_regions, data_length

KEYS = ("doc_id", "page_no", "stream_id")


def stream_text(content: Column) -> Column:
    """Bytes to text, one to one."""
    return F.decode(content, "ISO-8859-1")


def stream_bytes(text: Column) -> Column:
    """Inverse of ``stream_text``."""
    return F.encode(text, "ISO-8859-1")


def mask_literals(text: Column) -> Column:
    """Literals become ``()`` and hexadecimal strings ``<>``, as the audit reads a stream."""
    flat = F.regexp_replace(text, P.FLAT_LITERAL, "()")
    return F.regexp_replace(flat, P.HEX_LITERAL, "<>")


def _open_parts(rest: Column, is_last: Column) -> Column:
    """Open text and literals in turn of text that no image starts in; NULL where a region may run on behind it.

    Text that does not reach the end of its stream ends in a line end, so nothing after its last region means that
    the region is open. Literals deeper than a regular expression can follow are folded over.
    """
    def closed(parts: Column) -> Column:
        last = F.try_element_at(parts, F.lit(-2))
        ends_open = (F.size(parts) > 1) & (F.element_at(parts, -1) == "") & last.startswith("(") & (
            ~is_last | ~last.rlike(rf"^(?:{P.BALANCED})\z"))
        deeper = let(cut_regions(last, images=False), lambda own: F.concat(
            F.slice(parts, F.lit(1), F.size(parts) - 2), F.slice(own, F.lit(2), F.size(own))))
        return F.when(ends_open, deeper).otherwise(parts)

    def runs_on(parts: Column) -> Column:
        return ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")) | F.exists(
            F.transform(parts, lambda part, i: part.contains("<") & (i % 2 == 0) & part.rlike("<(?!<)")), lambda x: x)

    marked = F.regexp_replace(rest, P.PROTECTED_LITERAL, f"{P.MARK}$0{P.MARK}")
    return let(let(F.split(marked, P.MARK, -1), closed), lambda parts: F.when(is_last | ~runs_on(parts), parts))


def _image_length(piece: Column, is_last: Column) -> Column:
    """Length of the inline image that a piece starts with, 0 for none; NULL where it may end behind the piece."""
    def length(start: Column) -> Column:
        known = data_length(F.substring(start, F.lit(4), F.length(start) - 6))
        scanned = F.regexp_extract(F.substring(piece, F.length(start) + 1, F.length(piece)), P.SCANNED_IMAGE, 0)

        def by_size(stop: Column) -> Column:
            mark = F.when(F.substring(piece, stop + 1, F.lit(3)) == "\nEI", 3).otherwise(0)
            return F.when(stop <= F.length(piece), stop + mark).when(is_last, F.length(piece))

        def end(n: Column) -> Column:
            stop = F.length(start) + 1 + F.least(n, F.lit(2**30)).cast("int")  # the line end after ID too
            return F.when(n.isNotNull(), let(stop, by_size)).otherwise(let(F.length(scanned), lambda found: F.when(
                found > 0, F.length(start) + found).when(is_last, F.length(piece))))

        return F.when(start != "", let(known, end))

    return F.when(~piece.rlike(rf"^{P.IMAGE_START}"), 0).otherwise(
        let(F.regexp_extract(piece, P.IMAGE_HEAD, 0), length))


def with_parts(streams: DataFrame, images: bool = True) -> DataFrame:
    """Add ``parts``: open text and protected regions in turn; even items may be rewritten, odd ones may not.

    A stream is cut where an inline image may start. Each piece is an image, whose end stands in its header or is marked, and
    text whose literals a regular expression cuts. Only where a region runs on from piece to piece the whole
    stream is folded over token by token.
    """
    text = F.col("text")

    def cut(pieces: Column) -> Column:
        def parts(piece: Column, i: Column) -> Column:
            is_last = i == F.size(pieces) - 1

            def behind(n: Column) -> Column:
                image = F.substring(piece, F.lit(1), n)
                head = F.when(n == 0, F.array().cast("array<string>")).when(i == 0, F.array(F.lit(""), image)).otherwise(F.array(image))
                return F.concat(head, _open_parts(F.substring(piece, n + 1, F.length(piece)), is_last))

            return let(_image_length(piece, is_last) if images else F.lit(0), behind)

        return F.flatten(F.transform(pieces, parts))

    pieces = F.split(text, rf"(?={P.IMAGE_START})", -1) if images else F.array(text)
    return streams.withColumn("parts", F.coalesce(F.when(~text.contains(P.MARK), let(pieces, cut)), cut_regions(text, images)))


def _with(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select(*[k for k in KEYS if k in df.columns], *columns)


def protected_regions(streams: DataFrame) -> DataFrame:
    """One row per protected region: balanced literal, hexadecimal string or inline image."""
    regions = F.filter("parts", lambda part, i: i % 2 == 1)
    return (_with(with_parts(streams), F.posexplode(regions).alias("ordinal", "region"))
            .withColumn("kind", F.when(F.col("region").startswith("("), "literal")
                                 .when(F.col("region").startswith("<"), "hex").otherwise("inline_image")))


def tokenize(streams: DataFrame) -> DataFrame:
    """One row per token; white space is kept, so the tokens concatenate to the text."""
    tokens = F.flatten(F.transform("parts", lambda part, i: F.when(
        i % 2 == 0, F.regexp_extract_all(part, F.lit(P.TOKEN), F.lit(0))).otherwise(F.array(part))))
    tok = F.col("tok")
    return (_with(with_parts(streams, images=False), F.posexplode(tokens).alias("pos", "tok"))
            .withColumn("is_literal", tok.rlike(r"^(?:\([\s\S]|<[^<])"))
            .withColumn("is_space", tok.rlike(rf"^{P.WS}"))
            .withColumn("is_number", tok.rlike(P.NUMBER_TOKEN)))


def with_operands(streams: DataFrame) -> DataFrame:
    """One row per operator outside protected regions, with the numbers or the name just before it."""
    open_text = F.array_join(F.filter("parts", lambda part, i: i % 2 == 0), " () ")
    calls = F.regexp_extract_all(open_text, F.lit(P.OPERATOR), F.lit(0))
    words = F.split(F.regexp_replace("call", rf"{P.WS}++", " "), " ", -1)
    numbers = F.slice(F.col("words"), 1, F.size("words") - 1)
    return (_with(with_parts(streams), F.posexplode(calls).alias("ordinal", "call"))
            .withColumn("words", words)
            .withColumn("op", F.element_at("words", -1))
            .withColumn("name", F.when(F.col("call").startswith("/"),
                                       F.substring(F.get("words", F.lit(0)), 2, 1 << 30)))
            .withColumn("args", F.when(F.col("name").isNotNull(), F.array().cast("array<double>"))
                                 .otherwise(F.transform(numbers, lambda x: x.try_cast("double"))))
            .withColumn("n_args", F.size("args")).drop("call", "words"))
