"""attesta: composable DataFrame -> DataFrame operators for evidence analytics on Spark."""
