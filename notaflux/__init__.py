"""Clinical text analytics on Spark: DataFrames in, DataFrames out."""

from notaflux.conf import EngineConf

__all__ = ["EngineConf"]
