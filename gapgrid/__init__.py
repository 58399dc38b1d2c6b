"""Expected-versus-observed demand per hexagonal zone, as user-level operators on Spark DataFrames."""

from gapgrid.params import Params

__all__ = ["Params"]
