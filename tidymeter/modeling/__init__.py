"""Target transforms, leakage-aware validation, selection and training on MLlib."""
