"""DataFrame operators: cleaning, features, imputation, stratified splits."""
