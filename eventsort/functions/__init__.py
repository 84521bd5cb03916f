"""Scalar functions: Column to Column, all inside code generation."""
