"""Part of quarryline; see the README."""
