"""Tidemark: page-change analytics as Spark DataFrame plans.

Every operator is a function ``DataFrame -> DataFrame``; nothing collects data
of unbounded size to the driver, and hot keys are split before any window.
"""
