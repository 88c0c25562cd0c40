"""freshet: scenario-versus-baseline analytics as Spark DataFrame operators.

Sub-packages
------------
functions   column expressions, NULL semantics, unit conversions, fixed dimensions
operators   DataFrame -> DataFrame operators (impact, apportion, curve, flow, report)
sources     file readers and sinks
plans       whole analyses composed from the operators
streaming   intentionally empty, see its docstring
"""

__version__ = "0.1.0"
