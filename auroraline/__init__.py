"""Analytics over solar-wind and geomagnetic time series, on Spark."""
