"""The catalogue of parameters: identifiers, half levels, partners in vectors, factors of units."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Parameter:
    name: str
    param_id: int
    half_levels: bool = False
    v_component: str | None = None
    unit_factor: float = 1.0


#: Names and identifiers of parameters. Fixed values.
IDS = {
    "FI": 500006, "FIS": 500004, "FR_LAND": 500054, "P": 500001, "T_G": 500010, "T": 500014, "QV": 500035, "QC": 500100, "QI": 500101, "U": 500028, "V": 500030, "W": 500032,
    "PS": 500000, "U_10M": 500027, "U_10M_AV": 503743, "V_10M": 500029, "V_10M_AV": 503744, "T_2M": 500011, "TD_2M": 500017, "CLCT": 500046, "W_SNOW": 500044, "TOT_CON": 500043,
    "TOT_GSP": 500042, "ASOB_S": 500078, "ATHB_S": 500080, "ASHFL_S": 500087, "ASWDIR_S": 500480, "ASWDIFD_S": 500481, "OMEGA": 500031, "HHL": 500008, "HSURF": 500007,
    "TOT_PREC": 500041, "TQC": 500051, "ECHOTOPinM": 503422, "SLI": 503204, "DBZ_CMAX": 500175, "DBZ": 500174, "POT_VORTIC": 500544, "RELHUM": 500037,
}
#: Parameters on half levels, components of vectors (u to v), factors of units. Fixed values.
HALF_LEVELS = ("W", "HHL")
VECTORS = {"U": "V", "U_10M": "V_10M"}
UNIT_FACTORS = {"TOT_CON": 1000.0, "TOT_GSP": 1000.0}

PARAMETERS = {n: Parameter(n, i, n in HALF_LEVELS, VECTORS.get(n), UNIT_FACTORS.get(n, 1.0)) for n, i in IDS.items()}


def parameter(name: str) -> Parameter:
    """KeyError for a name that is not in the catalogue."""
    if name not in PARAMETERS:
        raise KeyError(f"no parameter {name}")
    return PARAMETERS[name]


def dimension(spark: SparkSession) -> DataFrame:
    """The catalogue as a table that requests and slabs are joined to by ``param``."""
    rows = [(p.name, p.param_id, p.half_levels, p.v_component, p.unit_factor) for p in PARAMETERS.values()]
    return spark.createDataFrame(rows, "param string, param_id int, half_levels boolean, v_component string, unit_factor double")


def vector_pairs(names: list[str]) -> list[tuple[str, str]]:
    """Pairs of components among ``names``; ValueError if one is there without the other."""
    out = []
    for u, v in VECTORS.items():
        if (u in names) != (v in names):
            raise ValueError(f"{u} and {v} are rotated together")
        if u in names:
            out.append((u, v))
    return out
