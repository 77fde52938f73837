"""Job plans: master merge, validation stage, features, status, model, prediction store."""
