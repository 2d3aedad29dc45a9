"""Command line: ``python -m weftmap.cli COMMAND ...``"""

from __future__ import annotations

import argparse
import json
import shlex
import sys
from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bins as B
from .operators import balance as BL
from .operators import ingest as I
from .operators import query as Q
from .plans.regions import parse_number
from .plans.resolutions import parse_resolutions
from .sources import collection as C
from .sources import text as T
from .sources.files import Files

#: Bins on a side of the tile that the coarsest resolution fits in.
TILE = 256
#: What the input's copies are, and what is done with the lower triangle then.
COPIES = {"unique": "reflect", "duplex": "drop"}


def _fields(specs: Sequence[str], default: str | None) -> tuple[dict, dict, dict]:
    """Columns to read, aggregates and types from field specifications."""
    columns, how, kinds = {}, {}, {}
    for spec in specs:
        name, number, dtype, agg = T.parse_field(spec)
        kind = T.sql_type(dtype) if dtype else ("bigint" if name == "count" else "double")
        if number:
            columns[name] = (number, "double" if kind in ("bigint", "int", "smallint", "tinyint") else kind)
            how[name] = agg or default
        kinds[name] = kind
    return columns, how, kinds


def _values(specs: Sequence[str] | None) -> dict:
    """Columns, their types and aggregates, for reductions; ``count`` without specifications."""
    columns, dtypes, how = [], {}, {}
    for name, number, dtype, agg in map(T.parse_field, specs or ["count"]):
        if number:
            raise ValueError(f"{name}: a stored column has no column number")
        columns.append(name)
        if dtype:
            dtypes[name] = T.sql_type(dtype)
        if agg:
            how[name] = agg
    return {"columns": columns, "dtypes": dtypes, "how": how}


def _storage(text: str | None) -> dict[str, str] | None:
    """``key=value`` pairs, comma-separated."""
    return dict(pair.split("=", 1) for pair in text.split(",")) if text else None


def _write_rows(rows: DataFrame, out: str | None, header: bool, na: str = "", float_format: str = "%g") -> None:
    """To a path as tab-separated files, or to standard output row by row."""
    if out:
        rows.write.mode("overwrite").options(sep="\t", header=header, nullValue=na, compression="gzip" if out.endswith(".gz") else "none").csv(out)
        return
    if header:
        print("\t".join(rows.columns))
    for r in rows.toLocalIterator():
        print("\t".join(na if x is None or x != x else float_format % x if isinstance(x, float) else str(x) for x in r))


def _metadata(spark: SparkSession, path: str | None):
    return json.loads(Files(spark).read(path)) if path else None


def cload(spark: SparkSession, a) -> None:
    genome, bins, size = T.parse_bins(spark, a.bins)
    columns, how, kinds = _fields(a.field, "sum")
    places = {"c1": a.chrom1, "p1": a.pos1, "c2": a.chrom2, "p2": a.pos2, "fields": columns, "comment": a.comment_char}
    pairs = T.read_pairs(spark, a.input, **places) if a.index is None else T.read_indexed_pairs(spark, a.input, a.index, **places)
    triangle = None if a.no_symmetric_upper else COPIES[a.input_copy_status]
    pixels = I.pixels_from_pairs(pairs, genome, how, binsize=size, bins=bins, one_based=not a.zero_based, triangle=triangle)
    C.create(a.output, bins, pixels, genome=genome, dtypes=kinds, symmetric=not a.no_symmetric_upper, assembly=a.assembly, metadata=_metadata(spark, a.metadata), mode="a" if a.append else "w", upper=False, storage=_storage(a.storage_options))


def import_(spark: SparkSession, a) -> None:
    from .sources.hdf5 import import_matrix

    import_matrix(spark, a.uri, a.output, "a" if a.append else "w")


def load(spark: SparkSession, a) -> None:
    genome, bins, size = T.parse_bins(spark, a.bins)
    columns, _, kinds = _fields(a.field, None)
    triangle = None if a.no_symmetric_upper else COPIES[a.input_copy_status]
    if a.count_as_float:
        kinds["count"] = "double"
    if a.format == "coo":
        rows = T.read_coo(spark, a.input, {"count": (3, "double"), **columns}, a.comment_char)
        pixels = I.sanitize_pixels(rows, one_based=a.one_based, triangle=triangle)
    else:
        rows = T.read_bg2(spark, a.input, {"count": (7, "double"), **columns}, a.comment_char)
        pixels = I.pixels_from_bg2(rows, genome, binsize=size, bins=bins, one_based=a.one_based, triangle=triangle)
    values = [c for c in pixels.columns if c not in ("bin1_id", "bin2_id")]
    C.create(a.output, bins, pixels, genome=genome, columns=values, dtypes={"count": "bigint", **kinds}, symmetric=not a.no_symmetric_upper, assembly=a.assembly, metadata=_metadata(spark, a.metadata), mode="a" if a.append else "w", duplicates=False, storage=_storage(a.storage_options))


def makebins(spark: SparkSession, a) -> None:
    genome = T.read_chromsizes(spark, a.chromsizes, all_names=True)
    _bed(B.binnify(spark, genome, parse_number(a.binsize)), a)


def digest(spark: SparkSession, a) -> None:
    genome = T.read_chromsizes(spark, a.chromsizes, all_names=True)
    _bed(B.restriction_bins(T.read_fasta(spark, a.fasta), genome, a.enzyme), a)


def _bed(bins: DataFrame, a) -> None:
    columns = ["chrom", "start", "end"]
    if a.rel_ids is not None:
        bins, columns = B.relative_ids(bins, a.rel_ids), [*columns, "rel_id"]
    _write_rows(bins.orderBy("bin_id").select(*columns), a.out, a.header)


def balance(spark: SparkSession, a) -> int | None:
    m = C.ContactMatrix(spark, a.uri)
    if a.check:
        return 0 if a.name in m.bins_frame.columns else 1
    if a.name in m.bins_frame.columns and not a.force:
        print(f"{a.name} exists; use --force", file=sys.stderr)
        return 1
    diags = a.ignore_diags if not a.ignore_dist else max(a.ignore_diags, -(-a.ignore_dist // m.binsize))
    blacklist = T.read_bed(spark, a.blacklist) if a.blacklist else None
    found = BL.balance(m.pixels_frame, m.bins_frame, cis_only=a.cis_only, trans_only=a.trans_only, ignore_diags=diags, mad_max=a.mad_max, min_nnz=a.min_nnz, min_count=a.min_count, blacklist=blacklist, tol=a.tol, max_iters=a.max_iters)
    if not found.stats["converged"]:
        if a.convergence_policy == "error":
            return 1
        if a.convergence_policy == "discard":
            return None
        if a.convergence_policy == "store_nan":
            found.weights[:] = float("nan")
    if a.stdout:
        print(*found.weights, sep="\n")
        return None
    m.store_balance(found, a.name, a.force)
    return None


def zoomify(spark: SparkSession, a) -> None:
    m = C.ContactMatrix(spark, a.uri)
    if a.legacy:
        C.zoom_levels(spark, a.uri, a.out or f"{a.uri.split('::')[0].rstrip('/')}.multi", **_values(a.field))
        return
    base = m.binsize or 1
    mean = 1 if m.binsize else B.mean_width(m.bins_frame)
    stop = ceil(m.genome.total / mean / TILE)
    out = a.out or f"{a.uri.split('::')[0].rstrip('/')}.multi"
    resolutions = parse_resolutions(a.resolutions, base, stop)
    if stop < base and any(t.strip()[-1:] in "bBnN" for t in a.resolutions.split(",")):
        print("the map fits one tile already: name resolutions to coarsen it more", file=sys.stderr)
    groups = C.zoomify(spark, [a.uri, *a.base_uri], out, [r for r in resolutions if r >= base], **_values(a.field))
    if a.balance or a.balance_args:
        for g in groups:
            uri = f"{out}::{g}"
            options = parser().parse_args(["balance", *shlex.split(a.balance_args or ""), uri])
            if options.name not in C.ContactMatrix(spark, uri).bins_frame.columns:
                balance(spark, options)


def merge(spark: SparkSession, a) -> None:
    C.merge(spark, a.output, a.inputs, mode="a" if a.append else "w", **_values(a.field))


def coarsen(spark: SparkSession, a) -> None:
    C.coarsen(spark, a.uri, a.out, a.factor, mode="a" if a.append else "w", **_values(a.field))


def info(spark: SparkSession, a) -> int | None:
    found = C.ContactMatrix(spark, a.uri).info
    if a.field:
        if a.field not in found:
            return 1
        print(found[a.field])
    else:
        print(json.dumps(found["metadata"] if a.metadata else found, indent=4))
    return None


def dump(spark: SparkSession, a) -> None:
    m = C.ContactMatrix(spark, a.uri)
    rows = m.dump(a.table, columns=a.columns.split(",") if a.columns else None, region=a.range, region2=a.range2, fill_lower=a.fill_lower, balanced=a.balanced, join=a.join, annotate=a.annotate.split(",") if a.annotate else (), one_based_ids=a.one_based_ids, one_based_starts=a.one_based_starts)
    if a.table == "bins":
        rows = rows.drop("bin_id", "chrom_id")
    elif a.table == "chroms":
        rows = rows.drop("chrom_id")
    _write_rows(rows, a.out, a.header, a.na_rep, a.float_format)


def csort(spark: SparkSession, a) -> None:
    genome = T.read_chromsizes(spark, a.chromsizes, all_names=True)
    pairs = T.read_pairs(spark, a.pairs, a.chrom1, a.pos1, a.chrom2, a.pos2, comment=a.comment_char, sep=a.sep.replace("\\t", "\t"))
    if not a.zero_based:  # the order is the same; positions are refused by their base
        pairs = pairs.where((F.col("pos1") > 0) & (F.col("pos2") > 0))
    _write_rows(I.sort_pairs(pairs, genome, by="blocks" if a.index == "pairix" else "positions", flip_only=a.flip_only), a.out, False)


def show(spark: SparkSession, a) -> int | None:
    m = C.ContactMatrix(spark, a.uri)
    rows, cols = m.extent(a.range), m.extent(a.range2 or a.range)
    if (rows[1] - rows[0]) * (cols[1] - cols[0]) > Q.SHOWN_CELLS:
        print("the region is too large to be shown", file=sys.stderr)
        return 1
    picked = m.matrix(balance=a.balanced).fetch(a.range, a.range2)
    picked = Q.scaled(picked, "balanced" if a.balanced else "count", a.scale)
    matrix = Q.to_matrix(picked.na.fill(0), (*rows, *cols), "balanced" if a.balanced else "count")
    try:
        import matplotlib.pyplot as plt
    except ImportError:
        print(matrix)
        return None
    plt.matshow(matrix, cmap=a.cmap)
    plt.savefig(a.out) if a.out else plt.show()
    return None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftmap")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name, run, *positional):
        c = commands.add_parser(name)
        for x in positional:
            c.add_argument(x)
        c.set_defaults(run=run)
        return c

    def text_input(c):
        c.add_argument("--field", action="append", default=[])
        c.add_argument("--comment-char", default="#")
        c.add_argument("--input-copy-status", choices=COPIES, default="unique")
        c.add_argument("-N", "--no-symmetric-upper", action="store_true")
        c.add_argument("--assembly")
        c.add_argument("--metadata")
        c.add_argument("-a", "--append", action="store_true")
        c.add_argument("--storage-options")

    c = command("cload", cload, "bins", "input", "output")
    text_input(c)
    for i, side in enumerate(("chrom1", "pos1", "chrom2", "pos2"), 1):
        c.add_argument(f"-{side[0]}{side[-1]}", f"--{side}", type=int, default=i)
    c.add_argument("-0", "--zero-based", action="store_true")
    c.add_argument("--index", choices=("tabix", "pairix"), help="the input is block-compressed: several tasks read it")
    c = command("import", import_, "uri", "output")
    c.add_argument("-a", "--append", action="store_true")
    c = command("load", load, "bins", "input", "output")
    text_input(c)
    c.add_argument("-f", "--format", choices=("coo", "bg2"), required=True)
    c.add_argument("--one-based", action="store_true")
    c.add_argument("--count-as-float", action="store_true")
    for name, run, inputs in (("makebins", makebins, ("chromsizes", "binsize")), ("digest", digest, ("chromsizes", "fasta", "enzyme"))):
        c = command(name, run, *inputs)
        c.add_argument("-o", "--out")
        c.add_argument("-H", "--header", action="store_true")
        c.add_argument("-i", "--rel-ids", type=int, choices=(0, 1))
    c = command("merge", merge, "output")
    c.add_argument("inputs", nargs="+")
    c.add_argument("--field", action="append")
    c.add_argument("-a", "--append", action="store_true")
    c = command("coarsen", coarsen, "uri")
    c.add_argument("-k", "--factor", type=int, default=2)
    c.add_argument("-o", "--out", required=True)
    c.add_argument("--field", action="append")
    c.add_argument("-a", "--append", action="store_true")
    c = command("zoomify", zoomify, "uri")
    c.add_argument("-r", "--resolutions", default="B")
    c.add_argument("-o", "--out")
    c.add_argument("--base-uri", action="append", default=[])
    c.add_argument("--balance", action="store_true")
    c.add_argument("--balance-args")
    c.add_argument("--legacy", action="store_true")
    c.add_argument("--field", action="append")
    c = command("balance", balance, "uri")
    for flag in ("--cis-only", "--trans-only", "--force", "--check", "--stdout"):
        c.add_argument(flag, action="store_true")
    for flag, kind, default in (("--ignore-diags", int, 2), ("--ignore-dist", int, 0), ("--mad-max", float, 5), ("--min-nnz", int, 10), ("--min-count", float, 0), ("--tol", float, 1e-5), ("--max-iters", int, 200), ("--name", str, "weight"), ("--blacklist", str, None)):
        c.add_argument(flag, type=kind, default=default)
    c.add_argument("--convergence-policy", choices=("store_final", "store_nan", "discard", "error"), default="store_final")
    c = command("info", info, "uri")
    c.add_argument("-f", "--field")
    c.add_argument("-m", "--metadata", action="store_true")
    c = command("dump", dump, "uri")
    c.add_argument("-t", "--table", choices=("chroms", "bins", "pixels"), default="pixels")
    for flag in ("--columns", "--annotate", "-o/--out", "-r/--range", "-r2/--range2"):
        c.add_argument(*flag.split("/"))
    for flag in ("--fill-lower", "-b/--balanced", "--join", "-H/--header", "--one-based-ids", "--one-based-starts"):
        c.add_argument(*flag.split("/"), action="store_true")
    c.add_argument("--na-rep", default="")
    c.add_argument("--float-format", default="%g")
    c = command("csort", csort, "pairs", "chromsizes")
    for i, side in enumerate(("chrom1", "pos1", "chrom2", "pos2"), 1):
        c.add_argument(f"-{side[0]}{side[-1]}", f"--{side}", type=int, default=i)
    c.add_argument("-i", "--index", choices=("tabix", "pairix"), default="pairix")
    c.add_argument("--flip-only", action="store_true")
    c.add_argument("-0", "--zero-based", action="store_true")
    c.add_argument("--sep", default="\\t")
    c.add_argument("--comment-char", default="#")
    c.add_argument("-o", "--out")
    c = command("show", show, "uri", "range")
    c.add_argument("-r2", "--range2")
    c.add_argument("-b", "--balanced", action="store_true")
    c.add_argument("--scale", choices=("linear", "log2", "log10"), default="log10")
    c.add_argument("--cmap", default="YlOrRd")
    c.add_argument("-o", "--out")
    command("ls", lambda s, a: print(*C.list_matrices(s, a.path), sep="\n"), "path")
    c = command("tree", lambda s, a: print(C.tree(s, a.path, a.level)), "path")
    c.add_argument("-L", "--level", type=int)
    command("attrs", lambda s, a: print(C.attributes(s, a.uri)), "uri")
    for name, options in (("cp", {}), ("mv", {"rename": True})):
        c = command(name, lambda s, a, options=options: C.copy(s, a.source, a.target, overwrite=a.overwrite, **options), "source", "target")
        c.add_argument("-w", "--overwrite", action="store_true")
    c = command("ln", lambda s, a: C.copy(s, a.source, a.target, overwrite=a.overwrite, link=not a.soft, soft=a.soft), "source", "target")
    c.add_argument("-w", "--overwrite", action="store_true")
    c.add_argument("-s", "--soft", action="store_true")
    return p


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    return a.run(spark or SparkSession.builder.appName("weftmap").getOrCreate(), a) or 0


if __name__ == "__main__":
    sys.exit(main())
