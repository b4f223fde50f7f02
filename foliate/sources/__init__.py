"""Readers of Parquet tables, Markdown trees and exported logs."""
