"""leadloom: contact-table cleaning written as Spark DataFrame operators."""

from leadloom.plans.pipeline import CleanOptions, CleanResult, clean, clean_leads

__all__ = ["CleanOptions", "CleanResult", "clean", "clean_leads"]
