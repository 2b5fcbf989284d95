"""Trip analytics and experimentation as Spark DataFrame operators."""

from tripledger.spec import CleanRules, DateWindow, TripSpec

__all__ = ["CleanRules", "DateWindow", "TripSpec"]
