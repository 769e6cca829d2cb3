"""A PySpark-native engine for multichannel time series, grouped statistics and protocol-aware evaluation."""
