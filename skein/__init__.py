"""skein: PySpark-native operators for agent-trajectory and task datasets."""
