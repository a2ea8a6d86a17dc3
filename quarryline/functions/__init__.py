"""Part of quarryline."""
