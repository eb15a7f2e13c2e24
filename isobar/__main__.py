"""``python -m isobar regrid``: fields of slab tables on another grid."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from isobar.field import Field
from isobar.metadata import with_origins
from isobar.operators import checked
from isobar.sources import slabs
from isobar.sources.parameters import vector_pairs



def rotate_vectors(fields: dict[str, Field]) -> dict[str, Field]:
    """Wind components on mass points and along geographic axes; ValueError if only one is there."""
    out = dict(fields)
    for u, v in vector_pairs(list(fields)):
        pair = [checked.destagger(f, d) if f.meta.is_staggered_horizontal else f for f, d in ((fields[u], "x"), (fields[v], "y"))]
        if pair[0].meta.vref != pair[1].meta.vref:
            raise ValueError(f"{u} and {v} refer to different axes")
        out[u], out[v] = checked.to_geographic_axes(*pair) if pair[0].meta.vref == "native" else pair
    return out


def regrid(spark: SparkSession, infiles: list[str], outfile: str, params: str, crs: str = "geolatlon", resampling: str = "nearest", ref_param: str = "HHL") -> None:
    """Fields of ``params`` on the grid of another system that covers theirs, every point present.

    Vectors need the reference parameter, which is read besides and written only if asked for.
    """
    source = slabs.DataSource.of_files(spark, infiles)
    wanted = [p.strip() for p in params.split(",")]
    pairs = vector_pairs(wanted)
    fields = slabs.load(source, {"param": wanted + [ref_param] * bool(pairs and ref_param not in wanted)})
    if pairs or ref_param in fields:
        fields = with_origins(fields, ref_param)
    missing = [p for p in wanted if p not in fields]
    if missing:
        raise RuntimeError(f"no values of {', '.join(missing)}")
    done = [checked.regrid(f, f.meta.grid.to_crs(spark, crs), resampling) for f in rotate_vectors({p: fields[p] for p in wanted}).values()]
    slabs.save(done, outfile)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="isobar")
    own = parser.add_subparsers(dest="command", required=True).add_parser("regrid", help="regrid PARAMS of INFILE to OUTFILE")
    own.add_argument("infile", nargs="+")
    own.add_argument("outfile")
    own.add_argument("params", help="names separated by commas")
    own.add_argument("--crs", default="geolatlon", choices=["geolatlon"])
    own.add_argument("--resampling", default="nearest", choices=["nearest", "bilinear", "cubic"])
    own.add_argument("--ref-param", default="HHL")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("isobar").getOrCreate()
    regrid(spark, args.infile, args.outfile, args.params, args.crs, args.resampling, args.ref_param)


if __name__ == "__main__":
    main()
