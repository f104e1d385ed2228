"""Training-data operators on texts and on matching; nothing outside this folder imports it."""
